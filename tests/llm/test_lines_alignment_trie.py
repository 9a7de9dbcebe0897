"""Line deduplication, tokenizer alignment and the conversation trie against brute force; odd inputs."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import alignment, common, line_dedup, prefix_trie, queries

SPACE = " \t\n\x0b\x0c\r"


def _lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def _kept(texts, min_docs, min_chars):
    keys = [[_lower(x.strip(SPACE)) for x in (t or "").split("\n")] for t in texts]
    n = Counter(k for own in keys for k in set(own))
    out = []
    for t, own in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, own, strict=True) if len(k) < min_chars or n[k] < min_docs]
        out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


LINES = ["a", "A ", "\ta", "á", "Á", "ÇA", "ça", "Ça", "×", "÷", "İ", "i", "", " ", " a", "x" * 3000, "line\r", "Line", "ß", "SS", "日本", "İ", "ÃŸ"]


@pytest.mark.parametrize(("min_docs", "min_chars", "broadcast"), [(3, 1, True), (2, 2, True), (2, 0, True), (3, 1, False)])
def test_line_dedup(spark, docs, monkeypatch, min_docs, min_chars, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 6))) for _ in range(40)] + [None, "", "\n", "\n".join(f"own {i}" if i % 3 else "line" for i in range(20_000))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_common_lines(docs(texts).withColumn("dropped", F.lit(1)).withColumn("h1", F.lit("x")), min_docs=min_docs, min_chars=min_chars).collect()}
    assert [got[i] for i in range(len(texts))] == _kept(texts, min_docs, min_chars)


def test_line_dedup_of_repeated_and_unnamed_rows(spark, docs):
    df = docs(["a\nb", None])
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0
    many = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((r.doc_id is None, r.text, r.n_dropped) for r in line_dedup.drop_common_lines(many, min_docs=3).collect())
    assert got == sorted([(False, "", 2), (False, "", 0)] * 2 + [(True, "", 2), (True, "", 0)])
    with pytest.raises(ValueError):
        line_dedup.drop_common_lines(df, min_docs=0)


def test_line_keys_tell_lines_apart(spark):
    lines = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x530), 0x2028, 0xE000, 0x10400, 0x1F600]] + ["Ã©", "é", "ã©"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup.keys_of(F.col("line"))[0].alias("key")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.key, set()).add(_lower(r.line.strip(SPACE)))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({_lower(x.strip(SPACE)) for x in lines})


needs_files = pytest.mark.skipif(not (os.path.exists(alignment.BYTE_BPE) and os.path.exists(alignment.PIECES)), reason="no vocabularies")


def _aligned(texts):
    """Tokens of both by their libraries, links by the owner of each byte, groups by walking along."""
    from tokenizers import Tokenizer

    sides, lib = alignment.Sides(alignment.BYTE_BPE, alignment.PIECES), Tokenizer.from_file(alignment.BYTE_BPE)
    lib.encode_special_tokens = True
    per, counts = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a, b = (lib.encode(" " + t, add_special_tokens=False).ids, sides.b.encode(t)) if t else ([], [])
        ab, bb = [sides.a_bytes[i] for i in a], [sides.b_bytes[i] for i in b]
        if not t or b"".join(ab) != whole or b"".join(bb) != whole:
            per.append(None)
            continue
        own_a, own_b = ([i for i, x in enumerate(s) for _ in x] for s in (ab, bb))
        links = sorted(set(zip(own_a, own_b, strict=True)))
        ends = {sum(map(len, ab[: i + 1])) for i in range(len(ab))} & {sum(map(len, bb[: i + 1])) for i in range(len(bb))}
        groups, pa, pb, na, nb = [], 0, 0, 0, 0
        for e in sorted(ends):
            sa, sb = pa, pb
            while na < e:
                na, pa = na + len(ab[pa]), pa + 1
            while nb < e:
                nb, pb = nb + len(bb[pb]), pb + 1
            groups.append((range(sa, pa), range(sb, pb)))
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        per.append((a, b, links, groups, pairs))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups, pairs = p
        text = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[i]) for i in y) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[q] == best[q[1]] for q in pairs), sum(counts[q] for q in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return out, per


PARTS = [" ", "  ", "\n", "\n\n\n", "\t", "\r\n", " ", "the", "Word", "Привет", "é", "é", "<|endoftext|>", "</s>", "'s", "!!", "12345", "日本", "▁", "\x00", "😀", "　", "᠎", "ﬁ", "aaaa", "I'll"]
ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@needs_files
@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 3])
def test_alignment(spark, docs, most):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(120)] + [None, "", " ", "\n", "the word " * 30, "the word " * 30]
    df = docs(texts).withColumn("links", F.lit("clash")).withColumn("row", F.lit(1))
    aligned = alignment.align_documents(df)
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in alignment.link_scores(aligned, alignment.pair_counts(aligned), most).collect()}
    assert [got[i] for i in range(len(texts))] == _aligned(texts)[0]


@needs_files
def test_alignment_links(spark, docs):
    texts = ["the word é日", "I'll 12345", "", None, "▁", "x" * 700]
    _, per = _aligned(texts)
    over = {(r.doc_id, r.a_pos, r.b_pos, r.a_id, r.b_id) for r in alignment.token_links(docs(texts)).collect()}
    assert over == {(i, x, y, p[0][x], p[1][y]) for i, p in enumerate(per) if p for x, y in p[2]}
    group = {(r.doc_id, r.a_pos, r.b_pos) for r in alignment.token_links(docs(texts), "group").collect()}
    assert group == {(i, x, y) for i, p in enumerate(per) if p for g, h in p[3] for x in g for y in h}
    assert alignment.tokenizer_alignment(docs(texts).limit(0)).count() == 0 and alignment.token_links(docs(texts).limit(0)).count() == 0
    with pytest.raises(ValueError):
        alignment.token_links(docs(texts), "other")


@needs_files
def test_alignment_of_very_long_and_repeated_texts(spark, docs):
    df = docs(["a" * 60_000, " " * 60_000 + "x", "word " * 60_000])
    got = alignment.tokenizer_alignment(df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 3
    want, _ = _aligned(["word one"])
    assert want[0][0] == 2 and all(r.n_links >= max(r.n_a, r.n_b) > 0 for r in got)


def test_csr_products():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in ((5, 7), (7, 4)))
        csr = lambda m: alignment.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])
        z = csr(x).times(csr(y))
        dense = np.zeros((5, 4), int)
        for i in range(5):
            dense[i, z.indices[z.indptr[i] : z.indptr[i + 1]]] += z.data[z.indptr[i] : z.indptr[i + 1]]
        assert (dense == x @ y).all()
        t = csr(x).transposed()
        assert t.indptr.tolist() == csr(x.T).indptr.tolist() and t.indices.tolist() == csr(x.T).indices.tolist() and t.data.tolist() == csr(x.T).data.tolist()


def _rebuilt(rows, share):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    if not share:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def _trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = lambda key: [k for k in members if k[: len(key)] == key]
    kids = Counter(k[:-1] for k in members if k)
    own = {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in members.items()}
    out = []
    for k, m in members.items():
        sub = below(k)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[x] for x in sub), sum(own[x] for x in sub), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _nodes(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def _conversations(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        # Distinct turn numbers: equal turns stand in an order of their own.
        for t in rng.sample([None, *range(12)], rng.randint(1, 6)):
            rows.append((c * rng.choice([1, 1, 1, 3]) + (c % 7 == 0) * 1000, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, ""])))
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    rows += [(None, 0, "user", "lost"), (5000, 0, "user", "y" * 200_000), (5001, 0, "user", "y" * 200_000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows, df = _conversations(spark, seed, 50)
    assert _nodes(prefix_trie.prefix_trie(df)) == _trie(_rebuilt(rows, False))
    assert _nodes(prefix_trie.trie_nodes(*prefix_trie.share_heads(prefix_trie.conversation_turns(df)))) == _trie(_rebuilt(rows, True))


def test_trie_whatever_the_sketch_and_the_broadcast_say(spark, monkeypatch):
    """A sketch of few cells lets nearly all prefixes pass, small bounds send rows through shuffled joins: the nodes stay the same."""
    rows, df = _conversations(spark, 3, 40)
    monkeypatch.setattr(prefix_trie, "SEGMENT", 16)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 16)
    monkeypatch.setattr(prefix_trie, "BROADCAST_BYTES", 5 * prefix_trie.NODE_BYTES)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    assert _nodes(prefix_trie.prefix_trie(df)) == _trie(_rebuilt(rows, False))


def test_trie_of_copies_repeated_rows_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", f"turn {t}") for c in range(30) for t in range(20)] + [(c, 20, "user", "more") for c in range(3)]
    df = spark.createDataFrame(rows, schema)
    assert _nodes(prefix_trie.prefix_trie(df)) == _trie(_rebuilt(rows, False))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    twice = prefix_trie.prefix_trie(df.unionByName(df))
    assert twice.agg(F.max("depth")).first()[0] == 42
    alone = _nodes(prefix_trie.prefix_trie(df.where("conv_id = 3")))
    assert len(alone) == 21 and {r[3] for r in alone} == {1}


def test_trie_screens_single_prefixes(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(200) for t in range(5)]
    turns = prefix_trie.conversation_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    paths = prefix_trie.prefix_paths(turns, turns.select("conv_id").distinct())
    n = {r.open: r["count"] for r in prefix_trie.screened(paths, *prefix_trie.count_min(paths, paths.count())).groupBy("open").count().collect()}
    assert 400 <= n[True] <= 410 and n[True] + n[False] == 1200


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_prefix_trie"])
def test_queries_match_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, cur.fetchall()))


@needs_files
def test_alignment_query(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    want, _ = _aligned([r.text for r in rows])
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in queries.op12_tokenizer_alignment(spark, sf).collect()}
    assert [got[r.doc_id] for r in rows] == want
