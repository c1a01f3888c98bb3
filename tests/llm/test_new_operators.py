"""The manifest, the link graph and the collocations against brute force, with nulls, ties, repeated rows, long texts, clashing names, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _text as X
from ledgerloom.llm import collocations, decontamination, fertility, linkgraph, merkle, sharding

UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# --- manifest

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, i int, leaf string, path string, claimed string"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def brute_leaf(row: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(hashes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[k : k + 16] for k in range(0, len(hashes), 16)]
        for j, i in enumerate(at):
            run, place = runs[i // 16], i % 16
            paths[j].append(("".join(run[:place]), "".join(run[place + 1 :])))
        at = [i // 16 for i in at]
        hashes = [sha("".join(run)) for run in runs]
    return hashes[0], paths


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    """rows: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, brute_leaf(row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, over = brute_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, over, strict=True):
        for (has, key, leaf), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            out.append((key if has else None, leaf, trees[s][0], root, [*path, *top]))
    return out


def order(x: tuple) -> tuple:
    return (x[0] is not None, x[0] or 0, *x[1:])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1}, {"a": 4097, "b": 300, "": 2, None: 15, "ß": 1, "z": 257}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_manifest(spark, sizes):
    rng = random.Random(len(sizes))
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "A b C", "é世", "word " * rng.randint(1, 30)])
            rows.append((k, source, rng.choice([None, "en"]), rng.choice([None, 5]), text))
            k += 1
    if len(sizes) > 2:
        rows += [rows[0], rows[-1], rows[-1], (None, None, None, None, None), (None, "a", None, None, "x"), (3, "a", "same id", 1, "other text"), (k, "a", "en", 1, "Long " * 200_000)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "K", 7, "L", "P", f"c{r[0]}") for r in rows], DOC)
    got = merkle.manifest(df.repartition(5), COLUMNS, carry=("key", "i", "path", "claimed")).select("doc_id", "leaf", "subroot", "root", "proof", "key", "i", "path", "claimed").collect()
    assert {(r.key, r.i, r.path) for r in got} == {("K", 7, "P")} and all(r.claimed == f"c{r.doc_id}" for r in got)
    found = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got), key=order)
    assert found == sorted(brute_manifest(rows), key=order)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC), COLUMNS).collect() == []


def test_a_changed_row_is_found(spark):
    rows = [(k, f"Text {k}", "en", f"s{k % 3}", k, "", 0, "", "", "") for k in range(100)]
    df = spark.createDataFrame(rows, DOC)
    changed = F.when(F.col("doc_id") == 41, "other").otherwise(F.col("text"))
    claimed = merkle.leaf(*(changed if c == "text" else F.col(c) for c in COLUMNS))
    found = merkle.manifest(df.withColumn("claimed", claimed), COLUMNS, carry=("claimed",))
    wrong = found.where(merkle.folded(F.col("claimed"), F.col("proof")) != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in wrong] == [41]


def test_blocks_are_whole_however_batches_are_cut():
    n = 3 * merkle.BLOCK + 50
    key, block = ["a"] * n + ["b"] * 10, [i // merkle.BLOCK for i in range(n)] + [0] * 10
    table = pa.table({"key": key, "block": block})
    for size in (7, 1000, 5000, n):
        tables = list(merkle._gathered(iter(table.to_batches(max_chunksize=size))))
        assert pa.concat_tables(tables).equals(table)
        ends = [(t.column("key")[-1].as_py(), t.column("block")[-1].as_py()) for t in tables]
        assert len(set(ends)) == len(ends)


# --- link graph

PAGE = "page_id long, url string, html string, host string, found int, verdict string"


def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER_TO_LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_rule(host, path, rules):
    fits = [(len(r), r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def brute_judged(pages, links, rules, steps=linkgraph.STEPS, passed=linkgraph.PASSED, limit=linkgraph.LIMIT):
    """pages: (id, url); links: the absolute addresses' hosts by url."""
    seen = [(i, *brute_host(u)) for i, u in pages]
    rule = [brute_rule(h, p, rules) for _, h, p in seen]
    hosts = {h for _, h, _ in seen if h}
    edges = {(h, t.translate(UPPER_TO_LOWER)) for (_, h, _), (_, u) in zip(seen, pages, strict=True) for t in links.get(u, ())}
    for h in hosts:
        up = h.partition(".")[2]
        if "." in up:
            edges |= {(h, up), (up, h)}
    edges = {(a, b) for a, b in edges if a != b and a in hosts and b in hosts}
    ranks = {}
    for kind, verdict, directed in (("trust", "allow", edges), ("distrust", "block", {(b, a) for a, b in edges})):
        of = Counter(h for _, h, _ in seen)
        share = Counter(h for (_, h, _), (_, v) in zip(seen, rule, strict=True) if v == verdict)
        base = {h: share[h] * linkgraph.UNIT // of[h] * (100 - passed) // 100 for h in hosts}
        degree, rank = Counter(a for a, _ in directed), dict(base)
        for _ in range(steps):
            now = dict(base)
            for a, b in directed:
                now[b] += rank[a] * passed // (100 * degree[a])
            rank = now
        ranks[kind] = rank
    out = []
    for (i, h, p), (r, v) in zip(seen, rule, strict=True):
        trust, distrust = ranks["trust"].get(h, 0), ranks["distrust"].get(h, 0)
        out.append((i, h, p, r, v or ("block" if distrust - trust >= limit else "allow"), trust, distrust))
    return out


def row_order(x):
    return tuple((v is not None, str(v)) for v in x)


@pytest.mark.parametrize("seed", [1, 2])
def test_link_graph(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{k}.{d}" for k in range(25) for d in rng.sample(["com", "net", "org", "example.com", "www.example.com"], 2)] + ["example.com", "a.h1.org", "h1.org", "b.a.h1.org"]
    pages, html, links = [], {}, {}
    for k in range(300):
        host = rng.choice(hosts) if k % 3 else "hot.example.net"
        url = f"{rng.choice(['http', 'HTTPS'])}://{host.upper() if k % 5 == 0 else host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{k}{rng.choice(['', '?q=http://x.com/', '#a'])}"
        to = rng.sample(hosts, rng.randint(0, 4))
        links[url] = to
        html[url] = '<nav><a href="/in">x</a><A class="b" HREF = \'https://' + "'>y</A><a href='http://".join(f"{t.upper()}/p?x=1" if i % 2 else t for i, t in enumerate(to)) + "'>z</a><link data-href=\"//no.com/\"><p>http://none.org</p>" if to else "<a href=/x>"
        pages.append((k, url))
    pages += [pages[0], pages[0], (None, None), (900, "no address"), (901, ""), (902, "http://"), (903, "http://COM?x"), (904, "x://com:80/en/"), (905, "a://h1.org\n/en/")]
    rows = [(i, u, html.get(u) if i != 2 else html.get(u) + "x" * 300_000, "clash", 1, "clash") for i, u in pages]
    got = linkgraph.judged(spark.createDataFrame(rows, PAGE).repartition(4)).collect()
    want = brute_judged(pages, links, linkgraph.RULES)
    assert sorted((tuple(r) for r in got), key=row_order) == sorted(want, key=row_order)
    judged_by_links = [w for w in want if w[3] is None and w[1]]
    assert {w[4] for w in judged_by_links} == {"allow", "block"}


def test_distrust_runs_to_those_who_link_and_trust_to_the_linked(spark):
    link = lambda *to: "".join(f'<a href="https://{t}/">x</a>' for t in to)
    rows = [(1, "http://good.com/de/", link("friend.org")), (2, "http://friend.org/", ""), (3, "http://bad.net/es/", link("victim.org")), (4, "http://victim.org/", ""), (5, "http://farm.org/", link("bad.net")), (6, "http://bad.net/en/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in linkgraph.judged(df).collect()}
    assert got[2].trust > 0 and got[2].distrust == 0
    assert got[4].distrust == 0 and got[4].verdict == "allow"
    assert got[5].distrust > 0 and got[6].verdict == "block"


@pytest.mark.parametrize("html", [None, "", "<p>no link</p>"])
def test_pages_without_links(spark, html):
    rows = [(1, "http://a.net/es/1", html), (2, "http://a.net/en/1", html), (3, "http://b.net/en/", html), (4, None, html)]
    got = {r.page_id: (r.rule, r.verdict) for r in linkgraph.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow")}


def test_no_pages(spark):
    assert linkgraph.judged(spark.createDataFrame([], PAGE)).collect() == []


# --- collocations


def brute_words(text):
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER_TO_LOWER))]


def brute_collocations(rows, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in brute_words(text):
            n[lang or "und" if lang is None else lang] += len(piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(piece[i : i + k]) for i in range(len(piece) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= percent * a for q, b in found.items()):
                continue
            score, cut = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, r, p.decode(), -a, l_, r_, n[lang], -s) for r, (s, a, p, l_, r_) in enumerate(sorted(kept)[:top], 1)]
    return out


def sentences(rng, n):
    vocabulary = ["Der", "la", "the", "and", "New", "york", "city", "é", "世", "a\x00b", "x\u00a0y", "\U0001f600", "don't", *(f"w{k}" for k in range(30))]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", " ; ", "\x0b"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(sentences(rng, rng.randint(0, 300)), rng.choice(["en", "de", None, "a language of a long name", "a language of a long nami"])) for _ in range(120)]
    return rows + [(None, "en"), ("", None), (" \t\n.,", "en"), (None, "only nulls"), ("New York city " * 40, "en"), ("x " * 30_000, "en"), ("x " * 30_000, "en"), (sentences(rng, 60_000), "de"), ("aa aa aa " * 20, "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(t, g, k, "clash", 1, 2, 3) for k, (t, g) in enumerate(rows)], "text string, lang string, doc_id long, phrase string, k int, f int, n int")


@pytest.mark.parametrize("least,percent,top", [(10, 50, 2000), (3, 80, 25), (300, 50, 2000)])
def test_collocations(spark, texts, least, percent, top):
    got = collocations.collocations(frame(spark, texts).repartition(6), least=least, percent=percent, top=top).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_collocations(texts, least, percent, top))


def test_counts_of_all_phrases(spark, texts):
    got = {(r.lang, r.phrase, r.k): r.f for r in collocations.phrase_counts(frame(spark, texts)).collect()}
    want = defaultdict(Counter)
    for text, lang in texts:
        lang = "und" if lang is None else lang
        want[lang, "", 0][""] += sum(map(len, brute_words(text)))
        for piece in brute_words(text):
            for k in (1, 2, 3):
                for i in range(len(piece) - k + 1):
                    want[lang, " ".join(piece[i : i + k]), k][""] += 1
    assert got == {p: c[""] for p, c in want.items() if c[""] >= 10 or p[2] == 0}


def test_a_full_sketch_changes_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "sieve", lambda cells: spark.sparkContext.broadcast(np.full(1 << 14, 2**64 - 1, np.uint64)))
    got = collocations.collocations(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_collocations(texts))


def test_no_texts(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []


def test_sketch_is_never_less_than_the_count():
    rng = np.random.default_rng(5)
    shown = collocations.Range()
    for n in (10, 1000, 1 << 23):
        cells = rng.integers(0, 1 << 24, n).astype("<u4")
        u, c = np.unique(cells, return_counts=True)
        half = np.minimum(c, 200)
        for part in (half, c - half):
            there = part > 0
            shown.add(np.ascontiguousarray(u[there].view(np.uint8).reshape(-1, 4)[:, :3]).tobytes(), np.minimum(part[there], 255).astype(np.uint8).tobytes())
        assert np.array_equal(np.sort(shown.taken(2)), u[c >= 2])
    assert not shown.sums.any() and len(shown.taken(1)) == 0


# --- mended


def test_items_without_an_id_are_hit(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (None, "none of it"), (7, "two three four five six seven eight nine ten eleven"), (8, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.items) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (12, ["7", None]), 2: (3, [None])}
    left = {r.doc_id: r.text for r in decontamination.decontaminated(docs, items).collect()}
    assert left[1].split() == ["x", "y"] and left[2].split() == []


def test_shards_of_tables_with_any_names(spark, tmp_path):
    names = "doc_id base bits bucket page shard n_bytes shard_bytes shard_docs depth text".split()
    rows = [(k, *(f"{c}{k}" for c in names[1:-1]), f"text {k} " * (k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} string" for c in names[1:]))
    placed = sharding.write_shards(df, f"{tmp_path}/out", max_bytes=100)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select(*names).collect())) == sorted(rows)
    assert {(r.doc_id, r.shard) for r in placed.collect()} == {(r.doc_id, r._shard) for r in back.select("doc_id", F.col("_shard").cast("string").alias("_shard")).collect()}
    assert back.select("_shard").distinct().count() > 2


def test_sql_counts_items_without_an_id_as_the_query_does(spark, tmp_path):
    import duckdb

    from ledgerloom.llm import queries as Q

    passage = " ".join(f"w{k}" for k in range(14))
    docs = [(1, f"a {passage.upper()} b"), (2, "w3 w4 w5"), (3, None), (4, "none here"), (4, "none here")]
    items = [(None, passage), (None, "none here"), ("b", passage), ("a", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), ("c", None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = Q.op2_decontamination(spark, str(tmp_path))
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({Q.decontamination.OP2_SQL})").fetchall()
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(want)
    assert [r[:4] for r in got] == [(1, 16, 14, 3), (2, 3, 0, 0), (3, 0, 0, 0), (4, 2, 2, 1), (4, 2, 2, 1)]


# --- memory of fertility's tasks


class TaskOf:
    """A table of documents whose mapInArrow gives the function that its tasks run."""

    schema = T.StructType([T.StructField("doc_id", T.LongType())])

    def select(self, *_):
        return self

    def mapInArrow(self, task, _):
        return task


def test_a_fertility_task_holds_little_beside_its_text(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 200_000, 2000)) for _ in range(600)]  # 9 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts), pa.nulls(600, pa.string())], names=["doc_id", "__text", "__language"])
    task = fertility.measures(TaskOf())
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(task(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.column("n_words").to_pylist() == [2000] * 600
    assert peak < 150e6


def test_a_vocabulary_that_forgets_gives_the_same_tokens(monkeypatch):
    monkeypatch.setattr(fertility, "REMEMBERED", 50)
    monkeypatch.setattr(fertility, "ENCODED", 7)
    rng = np.random.default_rng(4)
    for file in fertility.VOCABULARIES.values():
        model = fertility.Vocabulary(f"{fertility.TOKENIZERS}/{file}")
        for size in (0, 1, 30, 30, 45, 90, 20):  # more than are remembered, too
            words = sorted({f"Wort{k}ß" for k in rng.integers(0, 120, size)})
            buf, starts = X.joined([w.encode() for w in words])
            hashes, at = np.unique(X.span_hashes(buf, starts[:-1], starts[1:] - 1), return_index=True)
            row = model.rows(hashes, lambda which: [words[at[i]] for i in which])
            got = [model.tokens[model.ends[r] : model.ends[r + 1]].tolist() for r in row]
            assert got == list(map(list, model.encode([words[i] for i in at])))
