"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import textkit as K

UP = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(UP))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 7, 9, 20, 20, 40, 60, 120, 400)]
    out = [None, "", " \n ", "one", base[0], base[0]]
    for b in base[1:]:
        out.append(b)
        for edits in (1, 2, 4):
            w = b.split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out += [f"{rng.random()} start {passage} end {rng.random()}" for _ in range(6)]
    out += [base[5]] * 3 + ["a" * 300, "a" * 120, "ab" * 90]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i * 3 + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def with_clashes(df):
    """Further columns whose names the operators use inside."""
    return df.withColumns({"n": F.lit(1), "d": F.lit("x"), "id": F.lit(2), "score": F.lit("y"), "piece": F.lit(0), "h": F.lit(1), "ident": F.lit(0)})


def test_spans_do_not_cross_texts():
    import pyarrow as pa

    column = pa.array(["ab", "cd e", None, "", "f"])
    s = next(K.slices(column))
    starts, ends, doc = K.spans(s, K.SPACED, s.buf)
    assert [(s.buf[a:b].tobytes(), d) for a, b, d in zip(starts, ends, doc)] == [(b"ab", 0), (b"cd", 1), (b"e", 1), (b"f", 4)]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    from strataforge.llm.gsaca import suffix_array

    rng = np.random.default_rng(seed)
    for _ in range(300):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40)).tolist()
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def jaccard_brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def test_ngram_join(docs):
    from strataforge.llm.ngram_join import jaccard_components

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(with_clashes(docs)).collect()}
    assert got == jaccard_brute(rows)


def test_ngram_join_long_lists(spark, monkeypatch):
    """A star of near copies around one text, with every limit on lists reached."""
    from strataforge.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LOCAL_LIST", 2)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    rng = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == jaccard_brute(rows)


def test_ngram_join_large_sets(spark):
    """Texts of 900 to 5,000 words about the link's limit, some with many times another's bits of parity."""
    from strataforge.llm import ngram_join

    rng = random.Random(4)
    rows = []
    for base in range(4):
        words = [f"b{base}w{i}" for i in range((900, 1030, 2100, 5000)[base])]
        rows.append((len(rows), " ".join(words)))
        for share in (0.01, 0.02, 0.035, 0.05, 0.1):
            w = list(words)
            for _ in range(int(share * len(w))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w[: int(len(w) * rng.choice((1, 0.97)))])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == jaccard_brute(rows)


def test_fine_parity():
    from strataforge.llm import ngram_join as J

    rng = np.random.default_rng(5)
    for n, m in ((1024, 1025), (1500, 1700), (1100, 9000), (4096, 4097)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.r_[a[n // 10 :], rng.integers(0, 1 << 63, m - n + n // 10).astype(np.uint64)]
        x, y = (J.fine_parity(z) or J.parity(z) for z in (a, b))
        places = 8 * min(len(x), len(y))
        odd = set()
        for t in [*a.tolist(), *b.tolist()]:
            odd ^= {t % places}
        assert J.differing(x, y) == J.differing(y, x) == len(odd) <= len(np.setxor1d(a, b))
    assert J.fine_parity(a[:1024]) is None and len(J.fine_parity(a[:1025])) == 256 and J.fine_parity(a[:0]) is None


def test_pipeline_links_by_five_words(spark):
    from corpus_pipeline import near_duplicates

    base = [f"t{i}" for i in range(100)]
    near, far = base[:40] + [f"x{i}" for i in range(6)] + base[46:], base[:40] + [f"y{i}" for i in range(9)] + base[49:]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate((base, near, far))]
    assert sorted(r["doc_id"] for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == [0, 2]


def test_components(spark):
    from strataforge.llm.components import components

    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {**{i: 1 for i in range(2, 41)}, 101: 100, 102: 100}


def repeats_brute(rows, length=50):
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        smaller = {w for j, u in rows if j < i for w in windows((u or "").encode(), length)}
        for k, w in enumerate(windows(raw, length)):
            if w in smaller:
                gone[k : k + length] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), spans, hashlib.sha256(kept).hexdigest())
    return out


def windows(raw, length):
    return [raw[k : k + length] for k in range(len(raw) - length + 1)]


def test_suffix_dedup(docs):
    from strataforge.llm.suffix_dedup import find_repeats

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_bytes"], [(x["start"], x["end"]) for x in r["removed"]], r["kept_sha256"]) for r in find_repeats(with_clashes(docs)).collect()}
    assert got == repeats_brute(rows)


def test_anchors_fill_buckets_evenly():
    """Anchors have the least hashes: by their high bits the first of 100 buckets would get 15 times its share."""
    from strataforge.llm.suffix_dedup import Anchors

    buf = np.random.default_rng(5).integers(97, 123, 500_000).astype(np.uint8)
    keys = Anchors(K.Slice(0, buf, np.array([0, len(buf)])), 50).keys(100)
    share = np.bincount(keys >> 32, minlength=100) / len(keys)
    assert share.max() < 0.02
    assert len(np.unique(keys)) > 0.99 * len(keys)


def test_staged_tables_go_when_read(spark, docs):
    """Of a dedup or a join only what its result reads stays on disk, and no shuffle file of a staged table."""
    import time
    from pathlib import Path

    from strataforge.llm.ngram_join import jaccard_components
    from strataforge.llm.staging import shared_folder, stage
    from strataforge.llm.suffix_dedup import find_repeats

    shared = Path(shared_folder(spark).removeprefix("file:"))
    for operator, kept in ((find_repeats, {"told", "repeats"}), (jaccard_components, {"sets", "final", "tiny"})):
        before = set(shared.iterdir())
        out = operator(docs)
        assert {x.name.split("-")[1] for x in set(shared.iterdir()) - before} == kept
        assert out.count() == docs.count()

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffled()
    stage(docs.repartition(3, "doc_id").select("doc_id"), "dealt")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before


def test_decontaminate(spark, docs, texts):
    from strataforge.llm.decontaminate import find_windows

    rng = random.Random(1)
    items = [(None, "x y"), (9, None), (8, ""), (7, "one")]
    for k in range(12):
        w = (rng.choice([t for t in texts if t]) or "").split()
        at = rng.randrange(max(1, len(w) - 12))
        items.append((100 + k, " ".join(w[at : at + rng.choice((2, 5, 9, 14))]).upper()))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {}
    for r in docs.collect():
        d = pattern.findall((r["text"] or "").encode().translate(UP))
        hit, found = set(), set()
        for i, t in items:
            w = pattern.findall((t or "").encode().translate(UP))
            n = min(8, len(w))
            for a in range(len(w) - n + 1 if n and i is not None else 0):
                for b in range(len(d) - n + 1):
                    if d[b : b + n] == w[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(i)
        want[r["doc_id"]] = (len(d), len(hit), sorted(found))
    for block_words in (500_000, 3):  # one block, and several
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in find_windows(with_clashes(docs), benchmark, block_words=block_words).collect()}
        assert got == want


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from strataforge.llm.packing import pack, tokenize_pieces

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    got = pack(tokenize_pieces(docs, path, size=64), size=64, shard_pieces=30).collect()
    ids = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(ids[r["doc_id"]]) and 0 < r["length"] <= 64
        ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert dict(ids) == {r["doc_id"]: [*reference.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64


def test_tokens_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from strataforge.llm.packing import encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    for text in ("<|endoftext|> a", "x\u00a0y\u2003z  \n\n q", "½ ² ⅷ a's 'LL", "e\u0301 🙂 " * 3, "\x1c\x1d a\x85b", "a" * 5000, "日本語 テスト"):
        assert encoder(path).encode_with_added(text) == np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_tokens_of_an_unmodified_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from strataforge.llm.packing import encoder, tokenize_pieces

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    ids = lambda text: np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, end + end, f" {end} x", f"<|endoftext {end}|>", "plain"]
    for n in (9_999, 10_000, 10_001, 25_000):
        texts += [w for s in (" ", "\n", "\u3000") for w in (s * n, f"a{s * n}b", f"a{s * n} b{s * n}\n'll{s * n}{end}{s * n}")]
    for text in texts:
        assert encoder(path).encode_with_added(text) == ids(text)
    got = tokenize_pieces(spark.createDataFrame([(1, f"a{end}b")], "doc_id bigint, text string"), path).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[64, 50256, 65, 0]]
    assert len(encoder(path).encode_with_added("a" + " " * 1_000_000 + "b")) > 8


def test_media():
    from strataforge.llm import media_boxes as M

    for text in (None, "", "x", "é" * 700, "y" * 64):
        n, payload = M.padded(text)
        data = M.write_container(payload)
        (track,) = M.read_container(data)
        assert M.stored(data, track) == payload and n == len((text or "").encode())
        assert track.duration == len(track.samples) == len(payload) // 64
        assert track.keyframe_ranges()[0] == (data.index(b"mdat") + 4, 64)
    with pytest.raises(ValueError):
        M.read_container(data[:-10])


def test_media_query(docs):
    from strataforge.llm.media_boxes import encode_media, probe

    for r in probe(encode_media(docs)).join(docs, "doc_id").collect():
        payload = (r["text"] or "").encode()
        payload = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_ppm(docs):
    from strataforge.llm import ppm
    from strataforge.llm.queries import held_out

    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    tokens, raw = {i: [*words(t), None] for i, t in rows}, {i: b"\xfe" * ppm.ORDER + (t or "").encode().translate(UP) + b"\xff" for i, t in rows}
    for i, t in raw.items():
        if not held[i]:
            for k in range(ppm.ORDER, len(t)):
                for n in range(ppm.ORDER + 1):
                    counts[n][t[k - n : k]][t[k]] += 1

    def code(t):
        total = 0.0
        for k in range(ppm.ORDER, len(t)):
            out = set()
            for n in range(ppm.ORDER, -1, -1):
                c = counts[n].get(t[k - n : k])
                if not c:
                    continue
                rest = {s: v for s, v in c.items() if s not in out}
                whole = sum(rest.values()) + len(rest)
                if t[k] in rest:
                    total += math.log10(rest[t[k]] / whole)
                    break
                if rest:
                    total += math.log10(len(rest) / whole)
                out |= set(c)
            else:
                total -= math.log10(255 - len(out))
        return total

    known = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(known.values()), len(known)
    got = {r["doc_id"]: r for r in ppm.score(with_clashes(docs), held_out(7, 2), ppm.build(ppm.count_grams(docs.where(~held_out(7, 2))))).collect()}
    assert set(got) == set(held)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(known[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((known[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert abs(r["score"] - code(raw[i])) < 1e-3


def test_ppm_slices_take_little_memory():
    """What a slice is counted with: words and codes of all of it at once were 31 times its size on check_l."""
    import tracemalloc

    from strataforge.llm import ppm

    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(20_000)]
    texts = [" ".join(vocabulary[k] for k in rng.integers(0, 20_000, 500)).encode() for _ in range(3200)]
    s = K.Slice(0, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    held = np.arange(s.n) % 3 == 0
    tracemalloc.start()
    _, (codes, seen), n_words, h, doc, times = ppm._taken(s, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(s.buf)
    assert n_words.tolist() == [500] * s.n and times.sum() == 500 * s.n and (np.diff(codes.astype(np.int64)) > 0).all()
    assert (np.diff(h.astype(float)) >= 0).all() and len(np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1).T) == len(h)
    assert seen.sum() == sum(len(t) + 1 for k, t in enumerate(texts) if k % 3)


def test_wide_rows_are_held_one_by_one(spark, tmp_path):
    """Tables of rows of megabytes: a row group of many of them was written and read at once, and its statistics held them all."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from strataforge.llm.staging import light_batches, stage

    def cut(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(i).bytes(9 << 20)])], names=["a"])

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with light_batches(spark):
        table = stage(spark.range(0, 6, 1, 1).mapInArrow(cut, "a binary"), "wide", wide=True)
        assert max(r["n"] for r in table.mapInArrow(count, "n bigint").collect()) == 1
    assert spark.conf.get(key) == before
    for f in table.inputFiles():
        m = pq.ParquetFile(f.removeprefix("file://")).metadata
        assert m.num_row_groups == m.num_rows and not m.row_group(0).column(0).is_stats_set


def test_ppm_in_parts(docs):
    """The trie that is kept in parts scores as the whole one, contexts of one text included, and with nothing to learn from."""
    from strataforge.llm import ppm
    from strataforge.llm.queries import held_out

    for held in (held_out(7, 2), F.lit(True), F.lit(False)):
        whole = {r["doc_id"]: r for r in ppm.score(docs, held, ppm.build(ppm.count_grams(docs.where(~held)))).collect()}
        got = {r["doc_id"]: r for r in ppm.score(with_clashes(docs), held).collect()}
        assert set(got) == set(whole)
        for i, r in got.items():
            assert abs(r["score"] - whole[i]["score"]) < 1e-3 and r[:-1] == whole[i][:-1]


def test_ppm_query_keeps_every_context(spark, docs, tmp_path, monkeypatch):
    """No size of the model changes the scores of the query."""
    from strataforge.llm import ppm
    from strataforge.llm.queries import held_out, op9_lm_score

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {r["doc_id"]: r["score"] for r in ppm.score(docs, held_out(7, 2), ppm.build(ppm.count_grams(docs.where(~held_out(7, 2))))).collect()}
    if hasattr(ppm, "MAX_NODES"):
        monkeypatch.setattr(ppm.build, "__defaults__", (ppm.ORDER, 500))
    got = {r["doc_id"]: r["score"] for r in op9_lm_score(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_trie_with_fewer_nodes(docs):
    """The bounded way gives the whole trie where the bound is not reached, and a proper model where it is."""
    from strataforge.llm import ppm

    counts = ppm.count_grams(docs)
    whole = ppm.build(counts)
    n = len(whole.orders[-1].code)
    same = ppm.build(counts, max_nodes=n)
    assert (same.orders[-1].code == whole.orders[-1].code).all()
    small = ppm.build(counts, max_nodes=n // 3)
    assert 0 < len(small.orders[-1].code) <= n // 3
    context = int.from_bytes(b" word", "big")
    codes = np.array([(context << 8) | s for s in range(256) if s != 0xFE], np.uint64)
    assert abs((10.0 ** small.log10(codes)).sum() - 1) < 1e-4 and abs((10.0 ** whole.log10(codes)).sum() - 1) < 1e-4


def test_quality_and_toxicity(spark):
    from strataforge.llm import quality_nbsvm, toxicity_cnn
    from strataforge.llm.training import labelled_sample

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        w = [f"w{rng.randrange(60)}" for _ in range(30)]
        if i % 3 == 0:
            w = [x + "***" for x in w]
        if i % 4 == 0:
            w[rng.randrange(30)] = w[rng.randrange(30)] = "scoundrel"
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    rows += [(1000, None, None), (1001, "", "en"), (1001, "", "en")]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    train = F.col("doc_id") < 200
    model = quality_nbsvm.fit(labelled_sample(docs, labels, "quality", 500, train))
    got = quality_nbsvm.score(docs, model).join(labels, "doc_id", "left").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.5) == (r["quality"] == 1) for r in got if r["quality"] is not None)
    cnn, _, overall = toxicity_cnn.fit(labelled_sample(docs, labels, "toxic", 500, train, extra=("lang",)), "lang")
    got = toxicity_cnn.score(docs, cnn).join(labels, "doc_id", "left").collect()
    known = [r for r in got if r["toxic"] is not None and r["doc_id"] >= 200]
    assert sum((r["score"] >= 0.3) == (r["toxic"] == 1) for r in known) >= 0.95 * len(known) and 0 < overall < 1
    nothing = labelled_sample(docs, labels.limit(0), "quality", 500, train)
    assert {r["score"] for r in quality_nbsvm.score(docs, quality_nbsvm.fit(nothing)).collect()} == {0.5}


def test_language(spark, docs):
    from strataforge.llm.langid_hd import identify, prototypes

    some = spark.createDataFrame([(1, "der die und schön weiß", "de"), (2, "the and of with thing", "en"), (3, None, "en"), (4, "x", None)], "doc_id bigint, text string, lang string")
    profiles = prototypes(some)
    assert list(profiles) == ["de", "en"]
    more = spark.createDataFrame([(1, "und die schön"), (2, "thing with the"), (3, None), (4, ""), (5, "12 !?")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(more, profiles).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["de", "en", "und", "und", "und"] and got[3][1] == 0
    assert {r["lang_pred"] for r in identify(more, {}).collect()} == {"und"}


def test_url_reputation(spark):
    from strataforge.llm.queries import RULES
    from strataforge.llm.url_reputation import apply_rules, judge, reputation, with_parts

    rows = [(1, "http://A.Example.com/en/x?q#f"), (2, "https://www.example.com/en/1"), (3, "x://b.net/es/"), (4, None), (5, "no scheme"), (6, "http://c.org?x"), (7, "http://com/"), (8, "http://notexample.com/en/")]
    parts = with_parts(spark.createDataFrame(rows, "page_id bigint, url string"))
    good = spark.createDataFrame([("c.org", 0)] * 30 + [("b.net", 1)] * 30 + [("c.org", None)], "host string, good int")
    hosts, prior = reputation(good)
    got = {r["page_id"]: r for r in judge(apply_rules(parts, RULES), hosts, prior).collect()}
    assert [got[i]["rule"] for i in range(1, 9)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, "com/", "com/"]
    assert [got[i]["verdict"] for i in (1, 2, 3, 6, 7)] == ["block", "allow", "block", "block", "allow"]
    assert (got[1]["host"], got[1]["path"], got[6]["host"], got[6]["path"], got[4]["host"]) == ("a.example.com", "/en/x", "c.org", "", "")
    clash = with_parts(spark.createDataFrame([(1, "x://u/p", "h", 3)], "page_id int, url string, Host string, score int"))
    assert clash.columns == ["page_id", "url", "host", "path"] and clash.first()["host"] == "u"


def test_empty_tables(spark, docs):
    from strataforge.llm import langid_hd, media_boxes, packing, ppm
    from strataforge.llm.decontaminate import find_windows
    from strataforge.llm.ngram_join import jaccard_components
    from strataforge.llm.queries import held_out, tokenizer_path
    from strataforge.llm.suffix_dedup import find_repeats

    none = docs.limit(0)
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert jaccard_components(none).count() == find_repeats(none).count() == 0
    assert find_windows(none, benchmark).count() == 0 and find_windows(docs, benchmark).agg(F.sum("n_hit")).first()[0] == 0
    assert packing.pack(packing.tokenize_pieces(none, tokenizer_path())).count() == media_boxes.probe(media_boxes.encode_media(none)).count() == 0
    assert ppm.score(none, held_out(7, 2), ppm.build(ppm.count_grams(none))).count() == 0
    assert langid_hd.identify(none, langid_hd.prototypes(none)).count() == 0


def test_null_ids(spark):
    from strataforge.llm.ngram_join import jaccard_components
    from strataforge.llm.suffix_dedup import find_repeats

    text = " ".join(f"t{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (2, text), (5, text)], "doc_id bigint, text string")
    assert sorted(((r["doc_id"] or 0), r["component_id"]) for r in jaccard_components(df).collect()) == [(0, None), (2, 2), (5, 2)]
    assert sorted(((r["doc_id"] or 0), r["n_removed"] > 0) for r in find_repeats(df).collect()) == [(0, False), (2, False), (5, True)]
