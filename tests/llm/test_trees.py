"""The hash tree and the prefix trie against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomtext.llm import merkle, queries, trie

COLS = "doc_id long, text string, lang string, source string, n_chars long, key string, i long, n long, tree string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, fanout):
    """(top, proof of each leaf: a list of (left, right))."""
    proofs, at, row = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        for p, i in zip(proofs, at, strict=True):
            lo = i // fanout * fanout
            p.append((row[lo:i], row[i + 1 : lo + fanout]))
        row, at = [h(*row[lo : lo + fanout]) for lo in range(0, len(row), fanout)], [i // fanout for i in at]
    return row[0], proofs


def plain_manifest(rows, fanout=2):
    """One tuple (doc_id, leaf, subroot, root, siblings) per row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"], h(*[field(r[c]) for c in FIELDS])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, bytes.fromhex(x[1])))
        subs[g] = plain_tree([leaf for _, leaf in groups[g]], fanout)
    root, uppers = plain_tree([subs[g][0] for g in order], fanout)
    out = []
    for g, upper in zip(order, uppers, strict=True):
        for (k, leaf), proof in zip(groups[g], subs[g][1], strict=True):
            out.append((k, leaf, subs[g][0], root, h(*[x for left, right in proof + upper for x in left + right])))
    return sorted(out, key=str)


def told(got):
    got = got.select("key", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest("proof").alias("p"), merkle.folded("leaf", "proof").alias("f")).collect()
    assert all(r.f == r.root for r in got)
    return sorted([(r.key, r.leaf, r.subroot, r.root, r.p) for r in got], key=str)


def documents(n, langs, seed):
    rnd = random.Random(seed)
    return [(rnd.choice([None, i, i, i, i // 2]), rnd.choice([None, "", "é 中", f"text {rnd.randint(0, 9)}", "long " * 3000]), rnd.choices(langs, [50, *[1] * (len(langs) - 1)])[0], rnd.choice([None, "s"]), rnd.choice([None, 5]), "k", 1, 2, "t") for i in range(n)]


@pytest.mark.parametrize("n,langs,fanout,levels", [(1, ["en"], 2, 2), (2, ["en"], 2, 2), (61, ["en"], 2, 2), (300, ["en", None, "de", "é", "~"], 2, 3), (257, ["en", None, "fr"], 3, 2), (130, ["en", *[f"x{i}" for i in range(40)]], 2, 2), (200, ["en", "de"], 2, 10)])
def test_manifest_is_that_of_a_plain_tree(spark, n, langs, fanout, levels):
    df = spark.createDataFrame(documents(n, langs, n), COLS)
    got = merkle.manifest(df.repartition(7), fanout=fanout, levels=levels)
    assert told(got) == plain_manifest([r.asDict() for r in df.collect()], fanout)


def test_tampering_is_found(spark):
    df = spark.createDataFrame(documents(90, ["en", "de", None], 1), COLS)
    claim = merkle.leaf_of("doc_id", "source", "lang", F.lit(77).cast("long"), "text")
    got = merkle.manifest(df, levels=2, extra={"claim": claim}).select("root", merkle.folded("claim", "proof").alias("f")).collect()
    assert got and all(bytes(r.root).hex() != r.f for r in got)


def test_manifest_of_odd_and_no_rows(spark, odd_docs, no_docs):
    want = plain_manifest([r.asDict() for r in odd_docs.collect()])
    assert told(merkle.manifest(odd_docs)) == want
    assert told(merkle.manifest(odd_docs, levels=1)) == want
    assert merkle.manifest(no_docs).count() == 0


def test_runs_of_one_node_or_too_many_are_refused(no_docs):
    for fanout in (1, 256):
        with pytest.raises(ValueError):
            merkle.manifest(no_docs, fanout=fanout)


def plain_trie(convs):
    """One tuple per node, from {conversation: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def down(p):
        leaves, saved = (0, (len(members[p]) - 1) * len(p[-1][1])) if p else (0, 0)
        if not kids[p]:
            leaves += 1
        for k in kids[p]:
            a, b = down(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = set()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p)))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), *down(p), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(got):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect()}


def talks(seed, n=90, words=3):
    rnd = random.Random(seed)
    return {c: [(rnd.choice("us"), f"{rnd.choice('aé')}{rnd.randint(0, words)}") for _ in range(rnd.choice([0, 1, 2, 3, 5, 8]))] for c in rnd.sample(range(-50, 500), n)}


def table(spark, convs, seed=0):
    rows = [(c, t, r, x, "e", 1, 2) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string, d long, f long").repartition(5), spark.createDataFrame([(c,) for c in convs], "conv_id long")


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_nodes_are_those_of_a_plain_trie_even_where_fingerprints_collide(spark, bits):
    convs = talks(bits)
    assert nodes(trie.trie(*table(spark, convs), bits=bits)) == plain_trie(convs)


def test_a_long_conversation_is_spread_over_ranges(spark):
    rnd = random.Random(2)
    long_ = [("u", f"w{rnd.randint(0, 5)}") for _ in range(2600)]
    convs = {7: long_, 3: long_[:1500] + [("s", "other")], 9: long_[:1030], 10: long_[:1030], 2: [], 50: [("s", "x")]}
    got = nodes(trie.trie(*table(spark, convs)))
    members = defaultdict(list)
    for c, turns in convs.items():
        key = b""
        members[key].append(c)
        for r, x in turns:
            key = hashlib.md5(key + f"{len(r)}:{r}{x}".encode()).digest()
            members[key].append(c)
    assert len(got) == len(members) and sorted(r[3] for r in got) == sorted(map(len, members.values()))
    by = {(r[0], r[1]): r for r in got}
    assert by[2, 0][3:6] == (6, 2, 3) and by[2, 0][7] == hashlib.sha256(b"2").hexdigest()
    assert by[3, 1030][3:6] == (4, 1, 2) and by[3, 1030][7] == hashlib.sha256(b"9,10").hexdigest()
    assert by[3, 1500][4] == 2 and by[7, 2600][5:7] == (1, 0)
    shared = sum(len(x) * 3 for _, x in long_[:1030]) + sum(len(x) for _, x in long_[1030:1500])
    assert by[2, 0][6] == shared


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    convs = {c: [("u", "same")] for c in range(95, 260)} | {400: [("u", "other")]}
    assert nodes(trie.trie(*table(spark, convs))) == plain_trie(convs)


def test_odd_turns(spark):
    rows = [(1, None, None, None, "e"), (1, None, None, None, "e"), (1, 0, "", "x" * 9000, "e"), (2, 5, None, "", "e"), (None, 1, "u", "lost", "e"), (3, 1, "u", "b", "e"), (3, 1, "u", "a", "e"), (3, None, "u", "z", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rep string")
    want = {1: [("", ""), ("", ""), ("", "x" * 9000)], 2: [("", "")], 3: [("u", "z"), ("u", "a"), ("u", "b")]}
    assert nodes(trie.trie(df)) == plain_trie(want)
    assert trie.trie(df.limit(0)).count() == 0


def test_query_rebuilds_conversations(spark, tmp_path):
    rnd = random.Random(4)
    turns = {c: [(rnd.choice("us"), f"t{rnd.randint(0, 2)}") for _ in range(rnd.choice([1, 2, 3, 7]))] for c in [*range(0, 60), 203, 204, *range(300, 330)]}
    rows = [(c, t, r, x) for c, ts in turns.items() for t, (r, x) in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, own in turns.items():
        k = zlib.crc32(str(c).encode()) % 6
        want[c] = turns.get(c - c % 100, [])[:k] + own[k:]
    assert [] in want.values()
    assert nodes(queries.op12_trie(spark, str(tmp_path))) == plain_trie(want)
