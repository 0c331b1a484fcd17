"""Each opN query over a folder of odd tables: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import jaccard_brute, repeats_brute, words

from strataforge.llm import queries as Q
from strataforge.llm import textkit as K

EXTRA = {"n_hit": 1, "removed": "x", "score": "y", "component_id": 2, "sha": "s", "lang_pred": "z", "piece": 1, "codec": "c", "host": "h", "key": 1, "_first": 0}


def doubling(k, a="a", b="b"):
    """Two strings of 2^k letters that polynomial hashes modulo a power of two can't tell apart."""
    x, y = a, b
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


def table(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).withColumns({c: F.lit(v) for c, v in EXTRA.items()}).coalesce(2).write.parquet(path)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}ß" if i % 9 == 0 else f"Term{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, letter = make(40), make(80)
    out = [None, "", " \t\n", "one", "a <|endoftext|> b", make(30), *doubling(10), *(f"{x} y z" for x in doubling(10)), "\x00" * 90, "12 !?"]
    out += [f"{make(5)} {passage} {make(5)}" for _ in range(8)] + [letter] * 3
    out += [letter.replace("Term", f"Term{i}x", i) for i in range(1, 5)]
    out += ["ab" * 200, "ab" * 60, "a" * 100, "and the stupid scoundrel " * 12, make(50) + " scoundrel"]
    out += [make(60) for _ in range(25)]
    long = make(170_000)
    out += [long, long[:500_000] + " cut " + long[500_000:]]
    out = [(3 * i + 2, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in enumerate(out)]
    return out + [out[5], (None, make(30), "en", "s", 0)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    table(spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint", f"{path}/documents.parquet")
    labels = [(i, int("scoundrel" not in (t or "") and i % 5 > 0), int("scoundrel" in (t or "") or i % 7 == 0)) for i, t, *_ in rows if i is not None] + [(None, 1, 1), (5, None, None)]
    table(spark, labels, "doc_id bigint, quality int, toxic int", f"{path}/labels.parquet")
    texts = [t for _, t, *_ in rows if t and len(t) < 5000]
    items = [(i, " ".join(t.split()[2:13]).upper()) for i, t in enumerate(texts) if i % 3 == 0] + [(None, texts[3]), (900, None), (901, ""), (902, "one"), (903, "y z")]
    table(spark, items, "item_id bigint, text string", f"{path}/benchmark.parquet")
    urls = [f"http://{h}/{p}" for h in ("a.co.uk", "b.co.uk", "x.a.co.uk", "WWW.Example.com", "u@shop.org:80", "1.2.3.4", "bad.net", "n.bad.net") for p in ("", "en/1", "es/2?q", "fr/3#x")]
    pages = [(i, u) for i, u in enumerate([None, "", "none", "://", *urls, urls[0]])]
    table(spark, pages, "page_id bigint, url string", f"{path}/pages.parquet")
    return path


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def same_as_sql(spark, name, path):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        c.execute(f"create view {t} as select * exclude ({', '.join(EXTRA)}) from '{path}/{t}.parquet/*.parquet'{" where coalesce(length(text), 0) < 10000" if t == "documents" else ""}")
    got = Q.queries()[name](spark, path)
    if "doc_id" in got.columns:  # the SQL takes the square of a text's length
        got = got.where("n_words < 10000")
    columns = sorted(got.columns)
    want = c.execute(f"select {', '.join(columns)} from ({Q.oracle_sql()[name]})").fetchall()
    plain = lambda row: tuple(round(float(v), 5) if isinstance(v, float) else v for v in row)
    assert sorted(map(plain, want), key=repr) == sorted((plain(tuple(r[c] for c in columns)) for r in got.collect()), key=repr)


def test_op1(spark, folder):
    same_as_sql(spark, "op1_url_reputation", folder)


def test_op1_floor(spark, tmp_path):
    """The posterior bound decides: hosts of bad outcomes go under it, hosts of a bad domain without outcomes too."""
    hosts = [(h, n) for h, n in (("good.org", 40), ("bad.org", 40), ("sub.bad.org", 1), ("rare.good.org", 1))]
    pages = [(100 * i + k, f"http://{h}/{k}") for i, (h, n) in enumerate(hosts) for k in range(n)]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i, _ in pages if i < 200], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["host"]: (r["verdict"], r["lower"]) for r in Q.op1_url_reputation(spark, str(tmp_path)).collect()}
    assert {h: v for h, (v, _) in got.items()} == {"good.org": "allow", "bad.org": "block", "sub.bad.org": "block", "rare.good.org": got["rare.good.org"][0]}
    assert got["good.org"][1] > got["rare.good.org"][1] > got["sub.bad.org"][1]


def test_strengths_about_the_parents(spark):
    """Hosts that are alike within their domains, which differ: strong priors for hosts, weak ones for domains."""
    from strataforge.llm.url_reputation import reputation

    rows = [(f"h{h}.d{d}.com", int(k < (18 if d % 2 else 2))) for d in range(8) for h in range(5) for k in range(20)]
    _, prior = reputation(spark.createDataFrame(rows, "host string, good int"))
    assert prior["host"] > 100 and prior["domain"] < 5


def test_op2(spark, folder, rows):
    known = [(i, t) for i, t, *_ in rows if i is not None]
    got = [tuple(r) for r in Q.op2_ngram_join(spark, folder).collect()]
    want = jaccard_brute(list(dict(known).items()))
    assert sorted((r for r in got if r[0] is not None)) == sorted((i, *want[i]) for i, _ in known)
    x, y = ([i for i, t in known if t in (a, f"{a} y z")] for a in doubling(10))
    assert not {want[i][1] for i in x} & {want[i][1] for i in y}


def test_op2_form_letters(spark, monkeypatch):
    """Letters that share most of their words but not enough: long lists, and no pair of them links."""
    from strataforge.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LONG_LIST", 100)
    rng, common = random.Random(4), [f"c{i}" for i in range(88)]
    rows = [(i, " ".join([*common, *(f"o{rng.random()}" for _ in range(15))])) for i in range(1200)]
    rows += [(5000 + i, rows[i][1] + " end") for i in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}


def test_op3(spark, folder):
    same_as_sql(spark, "op3_decontaminate", folder)


def test_op3_item_ids(spark):
    from strataforge.llm.decontaminate import find_windows

    x, y = doubling(10)
    docs = spark.createDataFrame([(1, f"{x} q"), (2, f"{y} q")], "doc_id bigint, text string")
    for kind in ("smallint", "decimal(9,2)", "date", "string"):
        items = spark.createDataFrame([("2020", f"{x} Q")], "i string, text string").select(F.col("i").cast(kind).alias("item_id"), "text")
        got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in find_windows(docs, items).collect()}
        assert got[1] == (2, [items.first()["item_id"]]) and got[2] == (0, [])


def test_op4(spark, folder, rows):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(Q.tokenizer_path())
    got = Q.op4_packing(spark, folder).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) - 2048 * ((len(ids) - 1) // 2048)
        cuts = [(0, head), *((a, 2048) for a in range(head, len(ids), 2048))]
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(by) == -(-sum(n for _, _, _, n, _ in want) // 2048)


@pytest.mark.parametrize("seed", range(3))
def test_sum_of_squares(seed):
    """Each piece goes where the sum of squared counts of open sequences by gap ends smallest, the tightest of equals; a new one only where none has room."""
    from strataforge.llm.packing import sum_of_squares

    rng = random.Random(seed)
    lengths = [rng.randint(1, 40) for _ in range(300)]
    which, offset = sum_of_squares(np.array(lengths), 40)
    gaps = {}
    for n, b, a in zip(lengths, which.tolist(), offset.tolist()):
        def after(g):
            left = collections.Counter(x for x in [*(v for k, v in gaps.items() if k != g), gaps.get(g, 40) - n] if x)
            return sum(v * v for v in left.values())

        room = {}
        for k, v in gaps.items():
            if v >= n:
                room.setdefault(v, k)
        if room:
            costs = {v: after(k) for v, k in room.items()}
            best = min(costs.values())
            assert b in gaps and costs[gaps[b]] == best and gaps[b] == min(v for v, c in costs.items() if c == best)
        else:
            assert b not in gaps
        assert a == 40 - gaps.get(b, 40)
        gaps[b] = gaps.get(b, 40) - n
    assert len(gaps) <= 1.1 * -(-sum(lengths) // 40)


def test_packing_spreads_repeated_rows(spark):
    from strataforge.llm.packing import pack

    pieces = spark.range(60_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).cast("bigint").alias("length"))
    shard = pack(pieces).groupBy(F.pmod("sequence_id", F.lit(3))).count().collect()
    assert len(shard) == 3 and max(r["count"] for r in shard) < 25_000


def test_op5(spark, folder, rows):
    got = Q.op5_quality(spark, folder).collect()
    assert sorted((r["doc_id"] or -1 for r in got)) == sorted(i or -1 for i, *_ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in got if r["doc_id"] is not None)
    twice = [r["score"] for r in got if r["doc_id"] == rows[5][0]]
    assert len(twice) == 2 and len(set(twice)) == 1


def test_quality_against_plain_loops():
    """Ratios by counting, and weights that no small step makes better."""
    from strataforge.llm.quality_nbsvm import DIMENSIONS, Model, fit_hinge

    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 12)) + (100 if i % 2 else 0) * (rng.random() < 0.7) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)])
    model = Model(rows, labels, blend=1.0)
    total = [DIMENSIONS + sum(len(r) for r, y in zip(rows, labels) if y == c) for c in (0, 1)]
    ratio = {}
    for f in {int(x) for r in rows for x in r}:
        n = [1 + sum(f in r for r, y in zip(rows, labels) if y == c) for c in (0, 1)]
        ratio[f] = np.log(n[1] / total[1]) - np.log(n[0] / total[0])
    scale = np.zeros(DIMENSIONS)
    scale[list(ratio)] = list(ratio.values())
    sign = np.where(labels == 1, 1.0, -1.0)
    w = fit_hinge(rows, scale, sign, epochs=300)
    loss = lambda v: 0.5 * v @ v + sum(max(0, 1 - s * (v[r] @ scale[r] + v[-1])) ** 2 for r, s in zip(rows, sign))
    best = loss(w)
    for _ in range(200):
        step = np.zeros(len(w))
        step[rng.choice([*ratio, len(scale)], 3)] = rng.normal(0, 0.02, 3)
        assert loss(w + step) >= best - 1e-5
    assert abs(model.margin(rows[0]) - (fit_hinge(rows, scale, sign)[rows[0]] @ scale[rows[0]] + model.bias)) < 1e-9


def test_op6(spark, folder, rows):
    got = Q.op6_toxicity(spark, folder).collect()
    assert sorted((r["doc_id"] or -1 for r in got)) == sorted(i or -1 for i, *_ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["flagged"] is not None for r in got)
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in got if r["doc_id"] is not None)


def test_toxicity_forward_pass():
    """Scores of many texts at once against convolution and pooling in plain loops."""
    from strataforge.llm import toxicity_cnn as T

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["mild", "nice", "vile", "awful", "plain"]) for _ in range(n)) for n in [0, 1, 2, *range(3, 40)]]
    raw = [t.encode() for t in texts]
    s = K.Slice(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ids, edge = T.buckets(s)
    parts = [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]
    keep = T.Model._tabulate
    T.Model._tabulate = lambda self: (setattr(self, "kept", self.embedding.copy()), keep(self))
    try:
        model = T.Model(parts, np.array([int("vile" in t) for t in texts]))
    finally:
        T.Model._tabulate = keep
    want = []
    for p in parts:
        e = [sum(model.kept[model.number[b]] for b in forms) for forms in p]
        z = model.base
        for b, w in enumerate(T.WIDTHS):
            for f in range(T.FILTERS):
                values = [sum(e[i + j] @ model.filters[w][j][:, f] for j in range(w)) + model.bias[w][f] for i in range(len(e) - w + 1)]
                z += max([0.0, *values]) * model.out[b * T.FILTERS + f]
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(model.scores(ids, edge), want, atol=1e-4)


@pytest.mark.parametrize("hot", [4096, 2])
def test_op7(spark, folder, rows, monkeypatch, hot):
    from strataforge.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 4000 if hot == 2 else suffix_dedup.SLICE_BYTES)
    known = [(i, t) for i, t, *_ in rows if i is not None and len(t or "") < 10_000]
    got = [tuple(r) for r in Q.op7_suffix_dedup(spark, folder).collect()]
    want = repeats_brute(list(dict(known).items()))
    digest = {i: (i, n, sum(b - a for a, b in spans), len(spans), kept) for i, (n, spans, kept) in want.items()}
    assert sorted(r for r in got if r[0] in digest) == sorted(digest[i] for i, _ in known)
    long = sorted((i, t) for i, t, *_ in rows if len(t or "") > 10_000)
    (_, n, removed, spans, kept) = next(r for r in got if r[0] == long[1][0])
    assert spans == 2 and removed == n - 5 and kept == hashlib.sha256(b" cut ").hexdigest()


def test_suffix_array_decides(spark, folder, monkeypatch):
    """Entries of one anchor: windows by both suffix arrays against a comparison of all of them."""
    from strataforge.llm.suffix_dedup import ANCHOR, windows_of

    rng = np.random.default_rng(3)
    length, lead = 50, 30
    n = 400
    anchor = rng.integers(0, 6, n).astype(np.uint64)
    body = rng.integers(97, 99, (n, lead + length)).astype(np.uint8)
    body[:, lead - 12 : lead + 40] = 97
    body[:, lead - 13] = rng.integers(97, 99, n)
    body[np.arange(n), rng.integers(0, lead + length, n)] = 120
    body[:, lead : lead + ANCHOR] = anchor[:, None] + 60
    low, high = rng.integers(0, 10, n).astype(np.uint8), rng.integers(10, lead + 1, n).astype(np.uint8)
    offset = np.arange(-lead, length)
    body[(offset < -high[:, None].astype(int)) | (offset >= length - low[:, None].astype(int))] = 0
    owner = rng.integers(0, 200, n)
    least, mask = windows_of(anchor, body, low, high, owner, length)
    has = collections.defaultdict(list)
    for i in range(n):
        for o in range(low[i], high[i] + 1):
            has[o, anchor[i], body[i, lead - o : lead - o + length].tobytes()].append(owner[i])
    for i in range(n):
        for o in range(low[i], high[i] + 1):
            smaller = min(has[o, anchor[i], body[i, lead - o : lead - o + length].tobytes()])
            assert (owner[i] > smaller) == (owner[i] > least[i] or bool(mask[i] >> np.uint64(o) & np.uint64(1)))


def test_op8(spark, folder, rows):
    got = Q.op8_media(spark, folder).collect()
    by = collections.defaultdict(set)
    want = collections.Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    for r in got:
        assert r["media_bytes"] > r["payload_bytes"]
        by[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert {len(v) for v in by.values()} == {1}


def test_op9(spark, folder, rows):
    got = Q.op9_lm_score(spark, folder).collect()
    tokens = [(i, [*words(t), None]) for i, t, *_ in rows]
    held = lambda i: i is None or remainder(i, 7) == 2
    known = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(known.values()), len(known)
    base = lambda t: sum(np.log10((known[w] + 1) / (n + v + 1)) for w in t)
    want = sorted((i or -1, held(i), len(t), sum(known[w] > 0 for w in t), n, round(base(t), 3)) for i, t in tokens)
    assert sorted((r["doc_id"] or -1, *tuple(r)[1:5], round(r["base_score"], 3)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_op10(spark, folder, rows):
    """Against direct bundling, letter by letter."""
    from strataforge.llm.langid_hd import DIMENSIONS, signs

    def vector(t):
        x = [0]
        for c in t:
            low = c.lower()
            v = ord(low if len(low) == 1 else c) if c.isalpha() else 0
            if v or x[-1]:
                x.append(v)
        x.append(0)
        out = np.zeros(DIMENSIONS)
        for three, n in collections.Counter(zip(x, x[1:], x[2:])).items():
            a, b, c = signs(np.array(three))
            out += float(n) * (np.roll(a, 2) * np.roll(b, 1) * c)
        return out

    short = [r for r in rows if len(r[1] or "") < 10_000]
    long = [r for r in rows if len(r[1] or "") >= 10_000]
    cache = {t: vector(t) for t in {r[1] for r in short} | {r[1] for r in long} if t}
    profile = {}
    for i, t, lang, *_ in rows:
        if i is not None and remainder(i, 4) != 2 and t is not None and lang is not None:
            profile[lang] = profile.get(lang, 0) + (cache[t] if t else 0)
    got = {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in Q.op10_langid(spark, folder).collect()}
    for i, t, *_ in rows:
        if i is None:
            continue
        pred, score = got[i, remainder(i, 4) == 2]
        if not any(c.isalpha() for c in t or ""):
            assert (pred, score) == ("und", 0)
            continue
        cosine = {lang: cache[t] @ p / np.linalg.norm(cache[t]) / np.linalg.norm(p) for lang, p in sorted(profile.items())}
        assert abs(score - max(0, max(cosine.values()))) < 1e-9 and cosine[pred] >= max(cosine.values()) - 1e-9


def test_letters_of_all_scripts_differ():
    from strataforge.llm.langid_hd import signs

    v = signs(np.array([0x61, 0x430, 0x4E00, 0x4E00 + 720, 0x4E00 + 1440, 0xAC00])).astype(int)
    close = np.abs(v @ v.T - 1024 * np.eye(len(v)))
    assert close.max() < 200


def test_short_texts_stay_small():
    """Ten thousand short texts of their own 3-grams: no table of texts by 3-grams."""
    import tracemalloc

    import pyarrow as pa

    from strataforge.llm.langid_hd import bundle, gram_counts

    rng = random.Random(6)
    some = pa.array(["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(16)) for _ in range(10_000)])
    s = next(K.slices(some, K.SLICE_BYTES // 2))
    tracemalloc.start()
    bundle(*gram_counts(s)[:4], s.n)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20


def test_hashes_tell_structured_words_apart():
    x, y = (t.encode() for t in doubling(11))
    for a, b in ((x[:200], y[:200]), (x, y)):
        buf = np.frombuffer(a + b" " + b, np.uint8)
        h = K.span_hashes(buf, np.array([0, len(a) + 1]), np.array([len(a), len(buf)]))
        assert h[0] != h[1]
    one = np.frombuffer(b"xx word yy", np.uint8)
    other = np.frombuffer(b"word", np.uint8)
    assert K.span_hashes(one, np.array([3]), np.array([7]))[0] == K.span_hashes(other, np.array([0]), np.array([4]))[0]


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in Q.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_no_folder_on_a_cluster():
    from strataforge.llm.staging import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class Held:
                        def isDefined(self):  # noqa: N802
                            return False

                    class Context:
                        def getCheckpointDir(self):  # noqa: N802
                            return Held()

                    return Context()

    with pytest.raises(RuntimeError):
        shared_folder(Spark)


def test_lanes(spark):
    from strataforge.llm.staging import lanes, parts

    found = lanes(spark, 4 * parts(spark)).tolist()
    df = spark.createDataFrame([(x,) for x in found], "b int")
    assert len(set(found)) == len(found)
    assert {r["n"] for r in df.groupBy(F.pmod(F.hash("b"), F.lit(parts(spark))).alias("p")).agg(F.count("*").alias("n")).collect()} == {4}


