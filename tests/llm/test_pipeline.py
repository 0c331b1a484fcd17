"""Each stage of the corpus pipeline, and the run of all, against plain loops."""

import re

import numpy as np
from test_contracts import EXTRA, folder, rows  # noqa: F401
from test_llm import UP, repeats_brute, words

import corpus_pipeline as P
from strataforge.llm import queries as Q
from strataforge.llm import textkit as K

COLUMNS = ("doc_id", "text", "n_chars")


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def cut(text, spans):
    raw = (text or "").encode()
    gone = np.zeros(len(raw), bool)
    for a, b in spans:
        gone[a:b] = True
    return bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore") if spans else text


def quality(spark, docs, have, sf_dir):
    from strataforge.llm.quality_nbsvm import indicators

    model = Q.quality_model(spark, docs, sf_dir)
    out = []
    for r in have:
        raw = np.frombuffer((r[1] or "").encode(), np.uint8)
        if model.score(indicators(K.Slice(0, raw, np.array([0, len(raw)])))[0]) >= 0.5:
            out.append(r)
    return out


def near(have):
    known = sorted({(i, t or ""): (i, t, n) for i, t, n in have if i is not None}.values(), key=lambda r: (r[0], r[1] or ""))
    sets = []
    for _, t, _ in known:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [r for k, r in enumerate(known) if known[find(k)][0] == r[0]] + [r for r in have if r[0] is None]


def repeats(have):
    found = repeats_brute([(i, t) for i, t, _ in have if i is not None and len(t or "") < 20_000])
    out = []
    for i, t, n in have:
        spans = found[i][1] if i in found else []
        if not (spans and sum(b - a for a, b in spans) == len(t.encode())):
            left = cut(t, spans)
            out.append((i, left, len(left) if spans else None if left is None else len(left)))
    return out


def benchmark(spark, have, sf_dir):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = pattern.findall((r["text"] or "").encode().translate(UP))
        n = min(8, len(w))
        for a in range(len(w) - n + 1 if n and r["item_id"] is not None else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(r["item_id"])
    sizes = {len(w) for w in windows}
    out = []
    for i, t, _ in have:
        places = [(m.start(), m.end()) for m in pattern.finditer((t or "").encode().translate(UP))]
        w = pattern.findall((t or "").encode().translate(UP))
        hit, items = set(), set()
        for n in sizes:
            for b in range(len(w) - n + 1):
                found = windows.get(tuple(w[b : b + n]))
                if found:
                    hit.update(range(b, b + n))
                    items |= found
        if len(items) < 2:
            spans = []
            for k in sorted(hit):
                if spans and k - 1 in hit:
                    spans[-1] = (spans[-1][0], places[k][1])
                else:
                    spans.append(places[k])
            left = cut(t, spans)
            out.append((i, left, None if left is None else len(left)))
    return out


def test_stages(spark, folder, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    brute = [lambda d, have: quality(spark, d, have, folder), lambda d, have: near(have), lambda d, have: repeats(have), lambda d, have: benchmark(spark, have, folder)]
    for k, ((_, stage), plain) in enumerate(zip(P.STAGES, brute)):
        have = collected(docs)
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == docs.columns and set(EXTRA) < set(after.columns)
        want = sorted(plain(docs, have), key=repr)
        got = collected(after)
        if k in (2, 3):  # n_chars follows the text where something was cut
            got, want = ([r[:2] for r in x] for x in (got, want))
        assert got == want, P.STAGES[k][0]
        docs = after
    packed = P.STAGES[-1][1](spark, docs, folder)
    small = lambda df: sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in df.collect()), key=repr)
    assert small(packed) == small(P.run(spark, folder))


def test_n_chars_follows_the_text(spark, folder):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (P.repeated_passages, P.benchmark_passages):
        before = {r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in stage(spark, docs, folder).collect() if r["text"] not in before)


def test_rows_of_one_id_are_judged_each(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"z{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a, "x", "s", 0), (5, a + " more", "x", "s", 0), (5, b, "x", "s", 0), (5, b, "x", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, "").collect()) == [(1, a), (5, b)]


def test_empty(spark, folder, tmp_path):  # noqa: F811
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
