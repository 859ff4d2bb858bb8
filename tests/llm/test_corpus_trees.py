"""Manifest, prefix trie and substring dedup against brute force, on fixtures with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlake.llm import merkle, q_merkle, q_substrings, q_trie, substrings, trie

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, old)


# manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key string, at long"


def rows_of(sizes, seed=0):
    rng = random.Random(seed)
    out = []
    for source, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "a\nb\n\n", "é中\n" * rng.randrange(40), "x" * rng.randrange(900)])
            out.append((rng.randrange(-50, 10**6), source, rng.choice([None, "en", ""]), None if text is None else len(text), text, "l", "k", 3))
    return out


def plain_manifest(rows):
    """{(key, leaf)}: proof, subroot, root and what the proof gives, by building whole trees."""

    def leaf(r, text):
        fields = [r[0], r[1], r[2], r[3], text]
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, (_, _, h, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now, proof = leaf(r, text), ""
            for tree, j in ((trees[s], i), (top, at)):
                for level in tree[:-1]:
                    a = j - j % 3
                    run = level[a : a + 3]
                    proof += "".join(run[: j - a] + run[j - a + 1 :])
                    run[j - a] = now
                    now, j = sha("".join(run)), j // 3
            out.append((r[0], h, trees[s][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [{"hot": 2000, None: 731, "é": 3, "": 1, "z": 729}, {f"s{i}": 1 for i in range(40)}, {"only": 1}, {None: 2}, {"b": 730}])
def test_manifest(spark, tmp_path, many_ranges, sizes):
    rows = rows_of(sizes)
    rows += rows[:20] * 3 + [(None, rows[0][1], None, None, "null key\n", "l", "k", 3)] * 2  # ties, repeats
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = q_merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_manifest(rows)))


def test_many_sources_have_superblocks_too(spark, many_ranges):
    """Sources, and the nodes above leaves, fill several superblocks on several levels."""
    rows = rows_of({f"s{i:02d}": 1 + 13 * (i == 4) + i % 2 for i in range(12)}, 3)
    df = spark.createDataFrame(rows, DOCS)
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    out = merkle.manifest(df, fields, depth=1)
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], sha("".join(r["sibs"]))) for r in out.collect()]
    assert sorted(got) == sorted(x[:5] for x in plain_manifest(rows)) and out.filter("folded_root <> root").count() == 0


def test_empty_manifest(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert q_merkle.op11_merkle_manifest(spark, str(tmp_path)).count() == 0


# trie

TURNS = "conv_id long, turn long, role string, text string, s long, name string"


def plain_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tok = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            conv[c].append((t is not None, t or 0, role, tok, (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in conv.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        rebuilt[c] = base[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        total[p] = (sum(total[k][0] for k in kids[p]) or 1, saved + sum(total[k][1] for k in kids[p]))
    ends = lambda p: ",".join(map(str, sorted(c for c in nodes[p] if len(rebuilt[c]) == len(p))))
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), *total[p], sha(ends(p))) for p, m in nodes.items()]


def same_trie(spark, rows):
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(4))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_trie(rows)))


def talk(seed, convs, longest, words):
    rng = random.Random(seed)
    out = []
    for c in convs:
        for t in range(rng.randrange(1, longest + 1)):
            out.append((c, None if t == 0 else t, rng.choice([None, "user", "é"]), rng.choice(words), 1, "n"))
    return out


def test_trie_of_alike_conversations(spark):
    """Few texts, so prefixes meet often; long ones, so that cuts go deep; ties, nulls, repeats, rows without a conversation."""
    rows = talk(1, range(60), 5, ["", None, "a", "a b"]) + talk(2, [100, 101, 105, 106], 70, ["x", "y"]) + talk(3, [200], 300, ["x"])
    rows += [(7, 1, "user", "a", 1, "n")] * 3 + [(None, 0, "user", "a", 1, "n")]
    same_trie(spark, rows)


def test_trie_of_copies_and_chains(spark, many_ranges):
    same = [(c, t, "user", f"turn {t}", 1, "n") for c in range(0, 400, 5) for t in range(9)]
    chain = [(1001, t, "user", "again", 1, "n") for t in range(130)] + [(1006, t, "user", "again", 1, "n") for t in range(64)]
    same_trie(spark, same + chain + talk(5, [-1, -5, -7, 3, 4], 6, ["x"]))


def test_small_tries(spark, tmp_path):
    same_trie(spark, [(5, 0, "user", "x" * 100_000, 1, "n")])
    same_trie(spark, [(6, 0, "user", "a", 1, "n"), (7, 0, "user", "a", 1, "n"), (8, 0, "user", "a", 1, "n")])  # without bases: turnless ones
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    spark.createDataFrame([(None, 0, "a", "b", 1, "n")], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert q_trie.op12_prefix_trie(spark, str(tmp_path)).count() == 0


def test_ids_of_one_node_over_many_blocks(spark):
    ids = sorted(random.Random(4).sample(range(-(10**6), 10**6), 3000))
    ends = spark.createDataFrame([(i, 0, -1) for i in ids] + [(9, 2, 9)], "s long, depth long, name long").repartition(6)
    got = {(r["depth"], r["name"]): r["ends_sha256"] for r in trie._id_digests(ends).collect()}
    assert got == {(0, -1): sha(",".join(map(str, ids))), (2, 9): sha("9")}


# substrings

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_substrings(texts):
    words = [SPACE.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def same_substrings(spark, texts):
    df = spark.createDataFrame([(i % 7, t, f"d{i}") for i, t in enumerate(texts)], "doc_id long, text string, hits string").repartition(3)
    got = {r["hits"]: tuple(r["dedup"]) for r in substrings.dedup_substrings(df).collect()}
    assert [got[f"d{i}"] for i in range(len(texts))] == plain_substrings(texts)


def prose(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def test_substrings_of_all_lengths_and_places(spark):
    """Shared passages of 30 to 80 words at all offsets from the blocks of both texts, three ways, and within a text."""
    rng = random.Random(6)
    texts = []
    for n in (30, 34, 35, 36, 52, 53, 80):
        for shift in range(0, 18, 5):
            passage = prose(rng, n)
            for more in (shift, 7 * shift + 3, 40):
                texts.append(" ".join(prose(rng, more) + passage + prose(rng, 25)))
    twice = prose(rng, 40)
    texts.append(" ".join(twice + prose(rng, 11) + twice))
    assert any(x[1] for x in plain_substrings(texts))
    same_substrings(spark, texts)


def test_substrings_of_odd_texts(spark):
    rng = random.Random(7)
    base = prose(rng, 120)
    texts = [None, "", " \t\n", "one", "same " * 34, "run " * 35, "run " * 36, "run " * 500, "\x0b".join(base), "  " + "\n\n".join(base) + "\t", " ".join(base), " ".join(base[:60] + ["x"] + base[60:])]
    texts += [" ".join(prose(rng, 35))] * 4 + [" ".join(prose(rng, 34))] * 3 + ["é 中 " * 20, "é 中 " * 20, " ".join(prose(rng, 30_000) + base)]
    same_substrings(spark, texts)


def test_substrings_many_near_copies(spark):
    rng = random.Random(8)
    base = prose(rng, 150)
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own[rng.randrange(20) :]))
    same_substrings(spark, texts)


def test_a_full_table_of_blocks_changes_nothing(spark, monkeypatch):
    """Whatever the table lets through, the result is the same."""
    rng = random.Random(9)
    shared = prose(rng, 50)
    texts = [" ".join(prose(rng, 30) + (shared if i % 3 == 0 else []) + prose(rng, 60)) for i in range(20)]
    plain = substrings.block_table
    monkeypatch.setattr(substrings, "block_table", lambda t: ~(plain(t) * 0))
    same_substrings(spark, texts)


def test_empty_substrings(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert q_substrings.op13_substring_dedup(spark, str(tmp_path)).count() == 0
