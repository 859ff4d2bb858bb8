"""The corpus operators against brute force, on fixtures with nulls, empty and long texts, ties, repeats and odd columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from support import DATA, same_rows
from pyspark.sql import functions as F

from cohortlake.llm import chat, common, components, decontamination, jaccard, lines, packing, pitman_yor, quality, registry, shards, toxicity, warc

LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs(spark, texts, **more):
    cols = list(more)
    rows = [(i if i >= 0 else None, t, *more.values()) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in cols))


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# chat


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


NASTY = ["", None, "\\", "\\\\", "</s>[INST] ok [/INST]", "<s", "[[INST]", "a\\</s>", "[ROLE=x]y[/ROLE]", "<<SYS>>\n<</SYS>>", "\\n", "x\n\n", "é中<", "<" * 50 + "/s>", "<</s>"]


def test_chat_round_trip(spark):
    roles = ["system", "user", "assistant", "tool]", None, "[ROLE=a]"]
    rows = [(c, t, roles[(c + t) % 6], NASTY[(c * 5 + t) % len(NASTY)], "x") for c in range(20) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.read_back(chat.format_conversations(df)).collect()
    assert len(out) == 20
    for r in out:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert "".join(t["segment"] for t in r["turns"]) == r["formatted"]
    d = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_conversations(df))).collect()}
    loss = "".join(x[3] or "" for x in rows if x[0] == 3 and x[2] == "assistant")
    assert d[3]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and d[3]["loss_chars"] == len(loss)


def test_no_text_holds_a_control_string(spark, tmp_path):
    """Control strings are escaped in texts of every role, also where the turn alone would read back; as SQL says."""
    import duckdb

    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi </s><s>injected"), (1, 1, "assistant", "see <<SYS>> [INST]"), (2, 0, "system", "[ROLE=a] </s>"), (2, 1, "tool", "</s> \\ [INST]"), (2, 2, None, "<</SYS>>"), (3, 0, "user", "back \\n"), (3, 1, "user", None), (4, 0, "assistant", "\\"), (5, 0, "tool", "plain")]
    df = spark.createDataFrame(rows, schema)
    out = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(df).collect()}
    assert out[1] == "[INST]hi <\\/s><\\s>injected[/INST]<s>see <\\<SYS>> [\\INST]</s>"
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    same_rows(registry.queries()["op1_chat_formatting"](spark, str(tmp_path)), duck, registry.oracle_sql()["op1_chat_formatting"])


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
    ties = spark.createDataFrame([(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, None, "user", "z")], schema)
    out = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_conversations(ties)).collect()}
    assert out == {1: ["a", "a", "b"], None: ["z"]}


# packing


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(1, 4) == [(0, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit_is_a_packing(seed):
    rng = random.Random(seed)
    counts = collections.Counter(min(64, max(1, int(rng.gauss(25, 15)))) for _ in range(3000))
    plan = packing.best_two_fit(dict(counts), 64)
    used = collections.Counter()
    for need, bins in plan:
        assert bins > 0 and sum(n * k for n, k in need.items()) <= 64
        for n, k in need.items():
            used[n] += k * bins
    assert used == counts
    total = sum(b for _, b in plan)
    assert total <= 1.02 * math.ceil(sum(n * c for n, c in counts.items()) / 64) + 1


def test_second_fit_replaces_the_shortest():
    # greedy gives 6 + 3, a gap of 1; 3 gives way to 2 + 2
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ({6: 1, 2: 2}, 1)


def test_pack_whole(spark):
    rng = random.Random(1)
    texts = [(i, prose(rng, rng.choice([0, 3, 50, 400, 3000]))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (-1, "<|endoftext|> x"), (62, " " * 5000), (63, "a" * 5000)]
    out = packing.pack(docs(spark, texts, offset="clash", length="clash"), with_ids=True).collect()
    enc = packing.encoding(packing.VOCABULARY)
    want = collections.Counter()
    for i, t in texts:
        ids = [*enc.encode_ordinary(t or ""), 2]
        for p, (at, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i if i >= 0 else None, p, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"]
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.VOCABULARY)
    enc = packing.encoding(packing.VOCABULARY)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        for text in (r["text"], f"{r['text'][:300]}<|endoftext|> {r['text'][-300:]}"):
            assert t.encode(text, add_special_tokens=False).ids == enc.encode(text, allowed_special="all")


def test_special_ids_are_the_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "plain", "é\n<|endoftext|>\n"]
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 2]
    out = packing.pack(docs(spark, list(enumerate(texts))), with_ids=True, special=True).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == want
    docs(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["op2_best_fit_packing"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["length"] for r in got} == {i: len(x) for i, x in want.items()}


# language model


def test_tables_follow_their_law():
    """Tables of dishes of 4 customers after Gibbs sweeps, against the seatings counted one by one."""
    d, mass, w = 0.6, 3.0, 0.2
    law = collections.Counter()

    def seat(sizes, weight, left):
        if not left:
            law[len(sizes)] += weight
            return
        for i, n in enumerate(sizes):
            seat([*sizes[:i], n + 1, *sizes[i + 1 :]], weight * (n - d), left - 1)
        seat([*sizes, 1], weight * (mass + d * len(sizes)) * w, left - 1)

    seat([1], mass * w, 3)
    total = sum(law.values())
    n = 40_000
    seating = pitman_yor.Seating(np.full(n, 4))
    rng = np.random.default_rng(0)
    for _ in range(12):
        seating.sweep(np.zeros(n), np.full(n, w), mass, d, rng)
    for k, v in law.items():
        assert (seating.t == k).mean() == pytest.approx(v / total, abs=0.01)
    again = pitman_yor.Seating(np.full(n, 4)).fill(*seating.tables())
    for x in (seating, again):  # what is kept of seats is all that counts
        assert x.size.sum() == 4 * n and ((x.size.reshape(n, 4) > 0).sum(axis=1) == x.t).all()
    assert np.array_equal(np.sort(seating.size.reshape(n, 4)), np.sort(again.size.reshape(n, 4)))


@pytest.mark.parametrize("d", [0.1, 0.5, 0.75])
def test_tables_of_frequent_dishes(d):
    """After the sweeps of the operator, dishes of any number of customers have as many tables as all their seatings tell."""
    p, mass, others, n = 0.01, 1.0, 2000, 400
    got, want = [], []
    for c in (2, 30, 100, 1000, 3000):
        top = min(c, 400)
        way = np.full(top + 1, -np.inf)  # logarithm of the ways to seat the customers so far at 1, 2, ... tables
        way[1] = 0.0
        t = np.arange(top + 1)
        for k in range(1, c):
            with np.errstate(divide="ignore"):
                way = np.logaddexp(way + np.log(np.maximum(k - d * t, 0)), np.append(-np.inf, way[:-1]))
        weight = way + np.append(-np.inf, np.cumsum(np.log((mass + d * (others + t[:-1])) * p)))
        weight = np.exp(weight - weight.max())
        want.append((weight * t).sum() / weight.sum())
        rng, seating = np.random.default_rng(c), pitman_yor.Seating(np.full(n, c))
        for _ in range((pitman_yor.ROUNDS - 1) * pitman_yor.BURN_IN + pitman_yor.SWEEPS):
            seating.sweep(np.full(n, others), np.full(n, p), mass, d, rng)
        got.append(seating.t.mean())
        assert (seating.size.reshape(n, c).astype(np.int64).sum(axis=1) == c).all()
    assert got == pytest.approx(want, rel=0.05)


@pytest.mark.parametrize("d", [0.05, 0.4, 0.5, 0.75, 0.95])
def test_partings(d):
    """Sizes follow the weights of all ways to part a table; far beyond the exact ones the law goes on smoothly."""
    part, rng, s, n = pitman_yor.Parting(d), np.random.default_rng(4), 9, 200_000
    rise = [math.prod(k - d for k in range(1, i)) for i in range(s + 1)]
    weight = [math.comb(s - 1, j) * rise[j] * rise[s - j] for j in range(1, s)]  # customer 1 is at the first table
    assert part.rate(np.array([s]))[0] == pytest.approx(sum(weight) / rise[s])
    drawn = np.bincount(part.draw(np.full(n, s), rng), minlength=s)[1:] / n
    assert drawn == pytest.approx(np.array(weight) / sum(weight), abs=0.01)
    far = np.array([part.EXACT, part.EXACT + 1, 20 * part.EXACT])
    exact = [math.exp(math.lgamma(x - d) - math.lgamma(1 - d) - math.lgamma(x - 2 * d) + math.lgamma(2 - 2 * d)) for x in far]
    assert part.inverse_r(far) == pytest.approx(exact, rel=1e-6)
    second = part.draw(np.full(20_000, 20 * part.EXACT), rng)
    assert second.min() >= 1 and second.max() < 20 * part.EXACT


def test_predictions_sum_to_one():
    """Over all words and one unknown, after contexts that are known and that are not."""
    rng = np.random.default_rng(1)
    w = rng.zipf(1.5, 4000) % 40 + 1
    w[::7] = 0
    words = np.arange(45, dtype=np.uint64) << np.uint64(30)  # the last ones never occur
    order = np.lexsort((w[1:], w[:-1]))
    blob = pitman_yor.blob(words, w[:-1][order], w[1:][order], np.zeros(len(w) - 1))
    assert [list(x) for x in pitman_yor.opened(blob)[:3]] == [list(words), list(w[:-1][order]), list(w[1:][order])]
    model, stats = pitman_yor.counted([blob])
    bucket = pitman_yor.Bucket(model)
    seen = np.flatnonzero(bucket.count)
    assert stats[0] == len(w) - 1 == bucket.count.sum()
    customers = bucket.sent()
    for _ in range(4):
        tables = np.minimum(customers, 2)
        setting = pitman_yor.Setting(stats[0], len(seen), (0.7, 0.5), int(customers.sum()), int(tables.sum()))
        root = setting.root(customers, tables)
        bucket.sweep(root, setting, rng)
        state = bucket.state(setting)
        for near in (0, 1, 7, 44):
            every = np.append(seen, 44)
            p = pitman_yor.predicted(bucket, [state], root, np.full(len(every), near), every)
            assert p.min() > 0 and p.sum() == pytest.approx(1)
        assert (bucket.seating.n == bucket.c[bucket.some]).all()
        customers = bucket.sent()
        kept = pitman_yor.Bucket(model, bucket.seats())
        assert np.array_equal(kept.t, bucket.t) and np.array_equal(kept.sent(), customers)


def test_scores(spark):
    rng = random.Random(2)
    texts = [(i, prose(rng, rng.choice([0, 5, 200]), 80)) for i in range(120)] + [(120, None), (121, ""), (121, ""), (122, "A a é")]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    df = docs(spark, texts, score="clash")
    out = pitman_yor.score_texts(df, held, bucket_tokens=300).collect()
    toks = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]) for i, t in texts]
    c = collections.Counter(w for i, t in toks if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    again = pitman_yor.score_texts(df, held, bucket_tokens=300)
    assert sorted(round(r["score"], 9) for r in out) == sorted(round(r["score"], 9) for r in again.collect())
    assert pitman_yor.score_texts(df.limit(0), held).count() == 0


def test_predictions_follow_counts(spark):
    """A frequent word scores above an unknown one, and an early end is a probability."""
    train = [(i, "a b a c b a") for i in range(20)]
    probe = [(100 + k, w) for k, w in enumerate(["a", "b", "c", "zz", ""])]
    out = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs(spark, train + probe), F.col("doc_id") >= 100).collect()}
    assert out[100] > out[103]
    first = 10 ** out[104]  # the end straight away
    assert 0 < first < 1


def test_contexts_count(spark):
    """The word before tells which of two words comes next; a text that occurs twice scores above one that occurs once."""
    train = [(i, f"{x} {y} " * 5) for i in range(30) for x, y in [("p", "q"), ("r", "s")]]
    rng = random.Random(3)
    once, twice = (" ".join(f"{kind}{rng.randrange(100)}" for _ in range(60)) for kind in "uv")
    probe = [(100, "p q"), (101, "p s")]
    got = pitman_yor.score_texts(docs(spark, train + [(50, once), (51, twice), (52, twice)] + probe), F.col("doc_id") >= 100, bucket_tokens=200).collect()
    out = {r["doc_id"]: r["score"] for r in got}
    assert out[100] > out[101] + 1
    assert out[51] == pytest.approx(out[52]) and out[51] > out[50] + 5


# decontamination


def brute_hits(texts, items, window=10):
    words = {i: re.findall(LETTERS, low(t)) for i, t in items}
    spans = collections.defaultdict(set)
    for i, w in words.items():
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            spans[tuple(w[s : s + n])].add(str(i))
    out = {}
    for d, t in texts:
        w = re.findall(LETTERS, low(t))
        hit, found = set(), set()
        for n in {len(s) for s in spans}:
            for s in range(len(w) - n + 1):
                if x := spans.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= x
        out[d] = (len(w), len(hit), ",".join(sorted(found)))
    return out


@pytest.mark.parametrize("rows", [200_000, 0])
def test_decontamination(spark, monkeypatch, rows):
    """With few rows sent to all tasks, and with shuffles alone."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    rng = random.Random(3)
    items = [(i, prose(rng, n, 60)) for i, n in enumerate([30, 12, 10, 9, 4, 1, 15, 40])] + [(8, ""), (9, None), (10, prose(rng, 10, 60))]
    texts = []
    for i in range(60):
        w = prose(rng, rng.choice([0, 8, 100, 300]), 60).split()
        src = items[i % 8][1].split()
        a = rng.randrange(len(src))
        cutout = src[a : a + rng.randrange(1, 20)]
        at = rng.randrange(len(w) + 1)
        texts.append((i, " ".join([*w[:at], *cutout, *w[at:]]).upper() if i % 3 == 0 else ", ".join([*w[:at], *cutout, *w[at:]])))
    texts += [(60, None), (61, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.find_benchmark(docs(spark, texts, leaks="clash"), bench).select("doc_id", "leaks.*", decontamination.n_hit().alias("n_hit")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], ",".join(r["items"])) for r in out} == brute_hits(texts, items)
    assert decontamination.find_benchmark(docs(spark, texts), bench.limit(0)).filter(decontamination.n_hit() > 0).count() == 0


# WARC


def archive(spark, tmp_path, rows):
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    import glob
    import gzip

    return b"".join(gzip.open(f).read() for f in sorted(glob.glob(str(tmp_path / "w/part*"))))


def test_warc_round_trip(spark):
    rows = [(5, "http://a/\r\nb", "<p>same</p>"), (3, None, "<p>same</p>"), (3, "u", "<p>same</p>"), (9, "u", ""), (8, "u", None), (None, "u", "<p>same</p>"), (1, "u", "é WARC/1.1\r\n\r\n"), (2, "u", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.archived(df)
    got = collections.Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["ref"]) for r in back.select("*", warc.key_of(back["record_id"]).alias("id"), warc.key_of(back["refers_to"]).alias("ref")).collect())
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        same = [k for k, _, g in rows if (g or "") == (h or "") and k is not None]
        ref = min(same) if len(same) > 1 or i is None else i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref == i else "revisit", None if ref == i else ref] += 1
    assert got == want
    assert warc.archived(df.limit(0)).count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(spark, tmp_path, zipped):
    import gzip

    data = archive(spark, tmp_path, [(i, "http://x", f"<p>page {i}</p>" + "WARC/1.1\r\n" * (i % 2)) for i in range(8)])
    whole = list(warc.salvage(data))
    assert [x[0] for x in whole] == ["record"] * 8
    parts = [data[x[1] : x[1] + x[2]] for x in whole]
    if zipped:
        parts = [gzip.compress(p) for p in parts]
    damaged = [*parts]
    damaged[2] = parts[2][:40] + b"\xff\xff\xff" + parts[2][43:]
    damaged[5] = parts[5][: len(parts[5]) // 2]
    found = list(warc.salvage(b"".join([b"junk", *damaged, b"\x1f\x8b\x08tail"])))
    ids = [x[3][b"warc-record-id"] for x in found if x[0] == "record"]
    keep = [x[3][b"warc-record-id"] for i, x in enumerate(whole) if i not in (2, 5)]
    assert [i for i in ids if i in keep] == keep
    gaps = [x for x in found if x[0] == "gap"]
    assert gaps[0][1:3] == (0, 4) and len(gaps) >= 4 and all(g[3] for g in gaps)


def test_salvage_one_member(spark, tmp_path):
    import gzip

    data = archive(spark, tmp_path, [(i, "http://x", prose(random.Random(i), 300)) for i in range(20)])
    z = gzip.compress(data)
    found = list(warc.salvage(z[: len(z) * 3 // 4]))
    assert sum(x[0] == "record" for x in found) >= 12 and found[-1][0] == "gap"


def test_salvage_damage_inside_one_member(spark, tmp_path):
    import gzip

    data = archive(spark, tmp_path, [(i, "http://x", prose(random.Random(i), 300)) for i in range(40)])
    z = gzip.compress(data)
    assert len(z) < 1 << 16  # one step of the reader
    at = len(z) // 2
    found = list(warc.salvage(z[:at] + bytes(x ^ 0xFF for x in z[at : at + 60]) + z[at + 60 :]))
    assert sum(x[0] == "record" for x in found) >= 15 and found[-1][0] == "gap"


def test_warc_writes_a_member_per_record(spark, tmp_path):
    rows = [(i, "http://x", f"é{i} " + prose(random.Random(i), 300)) for i in range(20)] + [(20, "u", "x" * (17 << 20))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "m"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "m").glob("part*")))
    found = list(warc.salvage(whole))
    assert [x[0] for x in found] == ["record"] * 21 and len({x[1] for x in found}) == 21
    at = found[3][1] + found[3][2] // 2  # a break that stops inflation costs its record alone
    again = list(warc.salvage(whole[:at] + b"\xff" * 60 + whole[at + 60 :]))
    assert sum(x[0] == "record" for x in again) == 20


# toxicity


def brute_segments(scores):
    """All maximal segments by the definition of Ruzzo and Tompa: the best one, then left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2] or s == best[2] and b - a < best[1] - best[0]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return [*brute_segments(scores[:a]), best, *[(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]]


@pytest.mark.parametrize("seed", range(20))
def test_segments(seed):
    x = np.random.default_rng(seed).integers(-9, 8, 14) + 0.001 * np.random.default_rng(seed + 100).random(14)
    total = np.concatenate([[0], np.cumsum(x)])
    got = toxicity.segments(np.flatnonzero(x > 0), total)
    assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute_segments(x.tolist())]


def test_toxicity_learns(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        w = prose(rng, rng.choice([20, 100, 400]), 300).split()
        bad = i % 6 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["scumbag", "moronic", "vilest"]) for _ in range(4)]
        texts.append((i, " ".join(w)))
        if i < 450:
            labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (4, 0), (4, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = docs(spark, [*texts, (600, None), (601, ""), (-1, "x")], toxicity="clash")
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, toxicity.fit(df, lab)).collect()}
    assert all((out[i]["score"] >= 0.5) == (i % 6 == 0) for i in range(450, 600))
    assert out[600]["score"] < 0.5 and out[601]["score"] < 0.5
    p = out[450]["passages"]
    assert len(p) == 1 and p[0]["end"] - p[0]["start"] >= 4
    none = toxicity.score(df, toxicity.fit(df, lab.limit(0))).count()
    assert none == df.count()
    empty = df.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, lab)).count() == 0 and toxicity.score(df, toxicity.fit(empty, lab)).count() == df.count()
    again = toxicity.score(df.union(df.limit(3)), toxicity.fit(df, lab)).groupBy("doc_id").agg(F.count_distinct("toxicity.score").alias("n")).filter("n > 1")
    assert again.count() == 0


def test_evidence_of_several_passages():
    m = toxicity.Model(np.zeros(1), 1.0, 0.01, 1.0, 0.0)
    assert m.combined([], 100) == toxicity.CLIP[0] and m.combined([3.0], 100) == pytest.approx(3.0)
    one, three = m.combined([4.0], 100), m.combined([4.0, 4.0, 4.0], 100)
    assert three == pytest.approx(12 - 2 * math.log(12) + math.log(6) + math.log(2)) and three > one
    assert m.combined([4.0, 0.0, -1.0], 100) == one  # what a clean text holds anyway adds nothing


def test_rate_weighs_tokens_by_occurrence(spark):
    df = docs(spark, [(0, "a a a b"), (1, "b c")]).withColumn("y", F.lit(0))
    n = toxicity.token_counts(df, "text", "y")
    assert n[0, :-1].sum() == 4 and n[2, :-1].sum() == 6 and n[0, -1] == 2


def plain_segments(s):
    """By their definition: the segment of largest sum (the shortest of equal ones, the first of those), then in the same way
    what lies on both sides of it."""
    best = max(((sum(s[a:b]), a - b, -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return [*plain_segments(s[:a]), best[0], *plain_segments(s[b:])]


def test_scores_by_brute_force(spark):
    """The whole way from a text to its score: tokens, segments by their definition, evidence of the best r, the curve."""
    rng = random.Random(31)
    bad, fine = [f"bad{i}" for i in range(6)], [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choice(bad if i % 4 == 0 and rng.random() < 0.4 else fine) for _ in range(rng.randrange(5, 40)))) for i in range(240)]
    df = docs(spark, texts + [(900, None), (901, ""), (902, "BAD1 bad1! Bad2")], toxicity="clash")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    m = toxicity.fit(df, labels)
    assert (m.scores > 0).sum() >= 4
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, m).collect()}
    for i, t in [*texts, (900, ""), (901, ""), (902, "bad1 bad1 bad2")]:
        w = re.findall(LETTERS, low(t))
        (_, _, tok), = list(toxicity.tokens(__import__("pyarrow").array([" ".join(w)])))
        found = sorted((x * m.rate - math.log(max(m.scale, 1e-12) * max(len(w), 1)) for x in plain_segments([float(m.scores[k]) for k in tok])), reverse=True)
        best = toxicity.CLIP[0]
        for r in range(1, len(found) + 1):
            if r > 1 and found[r - 1] <= 0:
                break
            x = sum(found[:r])
            best = max(best, x - (r - 1) * math.log(max(x, 1)) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        best = min(max(best, toxicity.CLIP[0]), toxicity.CLIP[1])
        assert got[i]["n_words"] == len(w) and got[i]["evidence"] == pytest.approx(best, abs=1e-6)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(m.slope * best + m.offset))), abs=1e-9)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_toxicity_held_out_accuracy(spark):
    """Area under the curve on held-out rows, for each language with ten or more toxic ones. The bound was 0.95 while these
    rows had a part in the choice of constants; since they have none it is 0.93, as the review asks."""
    root = "/root/testdata/sf0.1"
    scored = registry.queries()["op6_toxicity"](spark, root).filter("held_out").join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang"), "doc_id")
    by = collections.defaultdict(list)
    for r in scored.select("lang", "toxic", "score").collect():
        by[r["lang"]].append((r["score"], r["toxic"]))
    seen = 0
    for rows in by.values():
        bad, good = ([s for s, y in rows if y == k] for k in (1, 0))
        if len(bad) >= 10:
            seen += 1
            assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good) >= 0.93
    assert seen >= 3


@pytest.mark.parametrize("gap,clean,toxic", [(" ", [f"прив{i}" for i in range(300)], ["привхам", "привгад", "привзло"]), ("", [chr(0x4E00 + i) for i in range(300)], ["鹿馬鹿", "馬鹿鹿", "鹿鹿馬"])])
def test_toxicity_tokens_are_whole(spark, gap, clean, toxic):
    """Toxic words that start as clean ones do, and words of a script without spaces, are told apart."""
    rng = random.Random(12)
    texts = []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(rng.choice([20, 100, 400]))]
        if i % 6 == 0:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(toxic) for _ in range(4)]
        texts.append((i, gap.join(w)))
    lab = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(450)], "doc_id long, toxic int")
    df = docs(spark, texts)
    out = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(df, toxicity.fit(df, lab)).collect()}
    assert all((out[i] >= 0.5) == (i % 6 == 0) for i in range(450, 600))


# Jaccard join


def brute_join(texts, t=0.8):
    sets = {}
    for i, x in texts:
        w = re.findall(LETTERS, low(x))
        sets[i] = frozenset([tuple(w[j : j + 5]) for j in range(len(w) - 4)] or ([tuple(w)] if w else []))
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    ids = sorted(rep.values())
    n, root = collections.Counter(), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 10 * len(x & y) >= 10 * t * len(x | y) - 1e-9:
                n[ids[a]] += 1
                n[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (rep[s], find(rep[s]), n[rep[s]]) for i, s in sets.items()}


def near_copies(rng):
    texts, base = [], [prose(rng, n, 5000).split() for n in (60, 120, 300)]
    for i in range(150):
        w = list(base[i % 3])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append((i, " ".join(w).title() if i % 7 == 0 else " ".join(w)))
    return texts + [(200, ""), (201, None), (202, "..."), (203, "a b"), (204, "A, b!"), (205, prose(rng, 20_000, 9000))]


@pytest.mark.parametrize("block", [1_000_000, 2_000])
def test_jaccard_join(spark, block):
    texts = near_copies(random.Random(5))
    out = jaccard.similar(docs(spark, texts, k="clash", s="clash"), block=block).collect()
    assert {r["k"]: (r["copy_of"], r["class_id"], r["n_links"]) for r in out} == brute_join(texts)


def test_jaccard_posting_lists(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)] + [np.arange(k, dtype=np.uint64) for k in (48, 50, 55)]
    sizes = np.array([len(x) for x in sets])
    args = (sizes, np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(sets), int), jaccard.Fraction(1, 2))
    dense = jaccard.links(*args)
    monkeypatch.setattr(jaccard, "BITS_BYTES", 0)
    posted = jaccard.links(*args)
    assert (posted[0] == dense[0]).all() and dense[0].sum() > 0 and (posted[2] == dense[2]).all() and 2 * dense[2].sum() == dense[0].sum()
    want = [sum(i != j and 2 * len(set(a) & set(b)) >= len(set(a) | set(b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert dense[0].tolist() == want


def test_keep_one(spark):
    texts = near_copies(random.Random(7))
    df = docs(spark, [*texts, (0, texts[0][1]), (0, texts[0][1]), (-1, texts[0][1])], class_id="clash")
    out = [r["doc_id"] for r in jaccard.keep_one(df).collect()]
    assert sorted(out) == sorted({c for _, c, _ in brute_join(texts).values()})
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_prefixes_are_shortened_as_far_as_needed():
    at, trees = np.array([0.8, 0.85, 0.99]), jaccard.TREES
    far = jaccard.next_length(np.array([]), np.array([]), 8, 0.8, trees, 0.9995)
    assert jaccard.meets(0.8, far, trees) >= 0.9995 > jaccard.meets(0.8, far + 1, trees)
    assert jaccard.next_length(at, np.array([0, 0, 10**6]), 8, 0.8, trees, 0.9995) == 8  # close copies meet at the longest
    mid = jaccard.next_length(at, np.array([0, 10**6, 0]), 8, 0.8, trees, 0.9995)
    assert far < mid < 8 and jaccard.next_length(at, np.array([10**6, 0, 0]), 8, 0.8, trees, 0.9995) == far


def test_jaccard_recall_of_planted_pairs(spark):
    """Pairs whose similarity is 0.8 to 0.9 by construction, among other texts: nearly all are found."""
    rng = random.Random(17)
    texts, pairs = [], []
    for i in range(300):
        w = prose(rng, 204, 10**6).split()
        v = list(w)
        for at in rng.sample(range(10, 190, 12), rng.choice([2, 3, 4])):  # each costs five shingles of 200 on both sides
            v[at] = f"x{rng.randrange(10**6)}"
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs.append((200 - 5 * sum(a != b for a, b in zip(w, v, strict=True))) / (200 + 5 * sum(a != b for a, b in zip(w, v, strict=True))))
    assert all(0.8 <= p < 0.95 for p in pairs) and sum(p < 0.85 for p in pairs) > 50
    out = {r["k"]: r["class_id"] for r in jaccard.similar(docs(spark, texts)).collect()}
    assert sum(out[2 * i + 1] == 2 * i for i in range(300)) >= 299


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(500, x) for x in range(501, 560)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{i: 500 for i in range(500, 560)}}


# lines


def test_line_dedup(spark):
    rng = random.Random(8)
    p = [prose(rng, 60) for _ in range(4)]
    multi = "\n".join(prose(rng, 9) for _ in range(8))
    short = "Common header line"
    own = lambda: prose(rng, 40)
    texts = [
        (1, f"{own()}\n{p[0]}\n{own()}"), (2, f"{short}\n{own()}\n{multi}"), (3, f"{short}\n  {p[0]}\n{own()}\n\n{multi}\n{own()}"), (4, f"{short}\n{own()}"),
        (5, f"{p[1]}\n{p[1]}\n{own()}"), (6, f"{own()}\n{p[1]}"), (7, None), (8, ""), (9, "\n\n"),
    ]
    texts += [(10, texts[3][1]), (10, texts[3][1]), (-1, f"{p[0]}\nnull key")]
    out = lines.dedup_lines(docs(spark, texts, repeats="clash", k="clash"), min_words=25).collect()
    got = {r["doc_id"]: (r["text"], r["repeats"]["deleted"] if r["repeats"] else []) for r in out}
    assert len(out) == len(texts)
    src = dict((i if i >= 0 else None, t) for i, t in texts)
    for i in (1, 2, 4, 5, 7, 8, 9):
        assert got[i][0] == src[i]
    third = src[3].split("\n")
    assert got[3][0] == "\n".join([third[2], "", third[-1]])  # the header line adjoins the passage, so it goes with it
    assert got[6][1] == [1] and got[10][0] == "" and got[None][0] == "null key"
    assert lines.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def test_line_dedup_finds_every_passage(spark):
    rng = random.Random(13)
    line = lambda n: prose(rng, n, 10**6)
    a, b, c, d, x, y, z = (line(12) for _ in range(7))
    x1, x2, e1, e2, q = (line(15) for _ in range(5))
    f = [line(8) for _ in range(5)]
    texts = [
        (1, [a, b, c, d]), (2, [b, x, a, b, c, d]), (3, [a, b, c, d, y, a, b, c, d]),  # a line also stands before; two copies
        (4, [x2, q, x1]), (5, [x1, x2]), (6, [z, x1, x2]),  # both lines are first in another document
        (7, [e1, line(9)]), (8, [e2, line(9)]), (9, [e1, e2]),  # no one document holds both
        (10, f[:2]), (11, f[1:3]), (12, f[2:4]), (13, f[3:]), (14, f), (15, [line(5), *f]),  # each pair has another owner
        (16, [c, line(3), a, line(3), b]), (17, [line(4)] * 2000), (18, [line(2), *[line(4)] * 2000]),
    ]
    out = {r["doc_id"]: r["repeats"]["deleted"] if r["repeats"] else [] for r in lines.dedup_lines(docs(spark, [(i, "\n".join(t)) for i, t in texts]), min_words=25).collect()}
    assert {i: v for i, v in out.items() if v} == {2: [2, 3, 4, 5], 3: [0, 1, 2, 3, 5, 6, 7, 8], 6: [1, 2], 15: [1, 2, 3, 4, 5]}


def test_alignment_chooses_the_occurrence():
    # the owner has other lines between a, b and c; the later document has one more b before them
    assert lines.align(list("bxabc"), list("aqbrc")) == [(2, 0), (3, 2), (4, 4)]
    one = {"ok": 1, "used": [2, 3, 4], "sure": [2, 3, 4]}
    assert lines.deletions([one, {"ok": 7, "used": [6], "sure": []}], [0, 1, 3, 4, 5, 6, 8]) == ([3, 4, 5], [1])


def test_line_order_matters():
    # b a is not aligned with a b: only one of the two lines can be
    assert len(lines.align(list("ab"), list("ba"))) == 1
    assert lines.rising([3, 1, 2, 2, 5]) == [1, 2, 4] or lines.rising([3, 1, 2, 2, 5]) == [1, 3, 4]
    assert lines.longest(list("xyxy"), list("yxyx"))[0][0] < 2 and len(lines.longest(list("xyxy"), list("yxyx"))) == 3


@pytest.mark.parametrize("kinds", [1, 2, 5, 20])
def test_alignment_by_bits_is_that_of_all_pairs(monkeypatch, kinds):
    rng = random.Random(kinds)
    cases = [[[rng.randrange(kinds + side) for _ in range(rng.randrange(60))] for side in (0, 1)] for _ in range(100)]
    want = [lines.longest(a, b) for a, b in cases]
    monkeypatch.setattr(lines, "MAX_MATCHES", -1)
    assert [lines.longest(a, b) for a, b in cases] == want


def test_alignment_of_many_equal_lines():
    a = list("xy") * 1000
    assert [i for i, _ in lines.longest(a, list("xxy") * 1000)] == list(range(len(a)))


def test_alignment_recurses():
    """Lines that are single only between two anchors are anchors there."""
    a, b = list("pqAqpBpq"), list("qpAqpBqp")
    got = lines.align(a, b)
    assert [(i, j) for i, j in got if 2 <= i <= 5] == [(2, 2), (3, 3), (4, 4), (5, 5)] and len(got) == 6
    assert lines.align(["l"] * 3000, ["l"] * 2500 + ["m"]) == [(i, i) for i in range(2500)]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_a_common_run(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefgh"[: rng.randrange(2, 9)]) for _ in range(rng.randrange(12))] for _ in range(2))
    got = lines.align(a, b)
    assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    if not got:
        assert not set(a) & set(b)


def test_three_documents(spark):
    """The passage of 2 and 3 is found although 1 holds each of its lines first, in the other order."""
    rng = random.Random(15)
    six = [prose(rng, 12, 10**6) for _ in range(6)]
    texts = [(1, "\n".join(six[::-1])), (2, "\n".join(six)), (3, "\n".join([*six, "tail"]))]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert out[3] == "tail" and out[1] == texts[0][1]


def brute_dedup(texts, rare, long, min_words):
    """All pairs of documents that share a rare line, a long one or two lines in a row, one by one: texts as lists of lines,
    all with words; by key."""
    hold, heavy = collections.defaultdict(set), set()
    n = lambda x: len(x.split())
    for i, t in texts.items():
        for x in range(len(t)):
            hold[t[x],].add(i)
            if n(t[x]) >= long:
                heavy.add((t[x],))
            if x + 1 < len(t):
                hold[t[x], t[x + 1]].add(i)
                heavy.add((t[x], t[x + 1]))
    pairs = {(a, b) for k, ids in hold.items() if len(ids) <= rare or k in heavy for a in ids for b in ids if b < a}
    out = {}
    for i, t in texts.items():
        own = []
        for a, b in pairs:
            if a == i:
                used = [x for x, _ in lines.align(t, texts[b])]
                own.append({"ok": b, "used": used, "sure": [p for r in lines.runs(used) if sum(n(t[q]) for q in r) >= min_words for p in r]})
        gone, _ = lines.deletions(own, list(range(len(t))))
        out[i] = [x for p, x in enumerate(t) if p not in gone]
    return out


@pytest.mark.parametrize("rows,min_words,rare", [(500_000, 1, 3), (0, 1, 2), (500_000, 12, 4)])
def test_line_dedup_by_brute_force(spark, monkeypatch, rows, min_words, rare):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", rows)
    rng = random.Random(16)
    pool = [prose(rng, rng.choice([1, 2, 5, 9, 13, 30]), 10**6) for _ in range(60)]
    texts = {}
    for i in range(70):
        t = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.randrange(1, 20), 10**6) for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(60)
        texts[i] = t + pool[at : at + rng.randrange(4)]
    df = docs(spark, [(i, "\n".join(t)) for i, t in texts.items()])
    out = {r["doc_id"]: r["text"].split("\n") if r["text"] else [] for r in lines.dedup_lines(df, min_words=min_words, rare=rare).collect()}
    assert out == brute_dedup(texts, rare, lines.LONG, min_words)


@pytest.mark.parametrize("holders", [2, 5, 9, 30])
def test_blocks_of_any_number_of_holders(spark, holders):
    """What is cut does not depend on how many documents hold it: long lines in another order in the first document, short
    blocks, and blocks that overlap in each other document."""
    rng = random.Random(17)
    long_, short, chain = [prose(rng, 30, 10**6) for _ in range(6)], [prose(rng, 6, 10**6) for _ in range(3)], [prose(rng, 5, 10**6) for _ in range(holders + 4)]
    texts = {0: long_[::-1]}
    for i in range(1, holders + 1):
        texts[i] = [prose(rng, 9, 10**6), *long_, prose(rng, 9, 10**6)]
        texts[100 + i] = [prose(rng, 9, 10**6), *short, prose(rng, 9, 10**6)]
        texts[200 + i] = [prose(rng, 9, 10**6), *chain[i : i + 3]]
    df = docs(spark, [(i, "\n".join(t)) for i, t in texts.items()])
    out = {r["doc_id"]: r["text"].split("\n") if r["text"] else [] for r in lines.dedup_lines(df).collect()}
    assert out == brute_dedup(texts, lines.RARE, lines.LONG, 1)
    for i in range(2, holders + 1):
        assert len(out[i]) == 2 and len(out[100 + i]) == 2 and len(out[200 + i]) <= 2


# salvage of much damage


def test_salvage_takes_time_in_proportion():
    """Archives of broken records only: five times the records take no more than some ten times as long."""
    import time

    took = []
    for n in (6_000, 30_000):
        broken = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: 90\r\n\r\ncut" % i for i in range(n))
        for data in (broken, broken.replace(b"\r\n\r\n", b"\r\n"), broken.replace(b"Length: 90", b"Length: 9")):
            began = time.process_time()
            got = list(warc.salvage(data))
            took.append(time.process_time() - began)
            assert [(g[0], g[1], g[2]) for g in got] == [("gap", 0, len(data))]
    assert all(late < 12 * early + 0.5 for early, late in zip(took[:3], took[3:], strict=True)), took


# quality


def test_quality_counts(spark):
    rng = random.Random(9)
    texts = [(i, "\n".join(prose(rng, rng.randrange(1, 30), 30) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rep = prose(rng, 12, 10**6)
    texts += [(60, f"{rep}\n{rep}\n {rep}\n\n \n{rep}"), (61, None), (62, ""), (63, "#$ é|<> x\r\nx\r\nx"), (64, " ".join(["same"] * 50)), (65, "xK9" * 4000)]
    out = quality.judged(docs(spark, texts, lang="en", kept="clash", quality="clash")).select("doc_id", "quality.*", "base_failed", "kept").collect()
    for r in out:
        t = dict(texts)[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cov = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert [r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)], r["doc_id"]
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cov) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
        for name, ids in tokens(t).items():
            assert r[f"{name}_tokens"] == len(ids), (r["doc_id"], name)
            if not ids:
                assert r[f"{name}_chars_per_token"] is None and r[f"{name}_byte_share"] is None and r[f"{name}_entropy"] is None
                continue
            p = np.array(list(collections.Counter(ids).values())) / len(ids)
            want = [len(t) / len(ids), sum(whole for whole in map(is_part(name), ids)) / len(ids), -(p * np.log2(p)).sum() / np.log2(len(ids)) if len(ids) > 1 else 1.0]
            assert [r[f"{name}_{m}"] for m in quality.LEAST] == pytest.approx(want)
    assert quality.judged(docs(spark, texts, lang="en").limit(0)).count() == 0
    twice = quality.judged(docs(spark, texts[:3] * 2, lang="en")).groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2}


def tokens(t):
    """Ids of a text by each vocabulary, by the libraries' own readers."""
    import base64

    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {"piece": sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(t), "multi": multi.encode_ordinary(t)}


def is_part(name):
    import base64

    import public_tokenizers as P
    import sentencepiece

    if name == "piece":
        sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        return lambda i: sp.id_to_piece(i).startswith("<0x") or i == sp.unk_id()
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return lambda i: "\ufffd" in ranks[i].decode("utf-8", "replace") and ranks[i] != "\ufffd".encode()


def test_quality_scripts(spark):
    texts = [(0, "plain text"), (1, "привет мир x"), (2, "猫犬鳥"), (3, "ひらがな 猫"), (4, "123 ..."), (5, ""), (6, "éàü"), (7, "한국어"), (8, "Ωμέγα")]
    got = {r["doc_id"]: r["script"] for r in quality.measures(docs(spark, texts)).select("doc_id", "quality.script").collect()}
    assert got == {0: "latin", 1: "cyrillic", 2: "han", 3: "kana", 4: "other", 5: "other", 6: "latin", 7: "hangul", 8: "greek"}


def test_quality_bands_by_brute_force(spark):
    """Verdicts against fences worked out one by one; a null language goes by script."""
    rng = random.Random(14)
    texts = [(i, prose(rng, rng.choice([19, 20, 30, 300]), 3000) + "".join(f" q𐍈{k}" for k in range(200 * (i % 17 == 0)))) for i in range(120)]
    df = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "xx"))
    rows = quality.judged(df).select("doc_id", "lang", "quality.*", "base_failed", "kept").collect()
    names = [f"{v}_{m}" for v in quality.VOCABULARIES for m in quality.LEAST]
    for lang in ("xx", None):
        own = [r for r in rows if r["lang"] == lang]
        ends = {}
        for m in names:
            x = sorted(r[m] for r in own if r["n_words"] >= 20)
            low, high = x[math.ceil(0.25 * len(x)) - 1], x[math.ceil(0.75 * len(x)) - 1]
            short = max(0.0, quality.LEAST[m.split("_", 1)[1]] - (high - low)) / 2
            ends[m] = (low - short, high + short)
        for r in own:
            reach = {m: (b - a) * 3 * math.sqrt(1 + 100 / r["n_words"]) for m, (a, b) in ends.items()}
            assert r["kept"] == (not r["base_failed"] and all(ends[m][0] - reach[m] <= r[m] <= ends[m][1] + reach[m] for m in names))
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in rows) < len(rows) / 2


def test_quality_bands_reject_misfits(spark):
    rng = random.Random(10)
    english = "the of and to in is that it was for on are with as his they be at one have this from".split()
    good = [(i, " ".join(rng.choice(english) for _ in range(rng.randrange(100, 300)))) for i in range(200)]
    bad = [(1000 + i, " ".join("".join(rng.choice("qzxjkvw0123456789") for _ in range(7)) for _ in range(150))) for i in range(5)] + [(2000, "猫犬鳥 " * 10 + " ".join(f"鷹{chr(0x4E00 + i)}" for i in range(150)))]
    out = {r["doc_id"]: r["kept"] for r in quality.judged(docs(spark, good + bad, lang="en")).collect()}
    assert not any(out[i] for i, _ in bad) and sum(out[i] for i, _ in good if True) >= 0.97 * sum(1 for i, _ in good)


# shards


def test_difference_is_the_textbook_run():
    # 8 7 6 5 4 in two parts: differencing gives 16 and 14
    part = shards.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(part, [8, 7, 6, 5, 4]).tolist()) == [14, 16]
    assert shards.difference(np.array([5]), 3).tolist() in ([0], [1], [2]) and len(shards.difference(np.zeros(0, int), 3)) == 0


@pytest.mark.parametrize("block", [16_384, 256])
def test_shards(spark, block):
    rng = random.Random(11)
    texts = [(i, prose(rng, int(rng.paretovariate(1.2) * 10) % 3000)) for i in range(700)]
    texts += [(1000 + i, texts[0][1]) for i in range(200)] + [(3000, None), (3001, ""), (3001, ""), (-1, "é")]
    out = shards.shard_by_bytes(docs(spark, texts, shard="clash", item="clash"), shards=8, block=block, reduce=8).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == collections.Counter((i if i >= 0 else None, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    for s, rows in by.items():
        assert 0 <= s < 8 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
    of = {r["doc_id"]: r["shard"] for r in out}
    assert len({of[0], *[of[1000 + i] for i in range(200)]}) == 1 and of[3000] == of[3001]
    total = [sum(r["size"] for r in by[s]) for s in range(8)]
    big = 201 * (len(texts[0][1].encode()) + 16)
    assert max(total) <= max(big, 1.03 * sum(total) / 8) and shards.shard_by_bytes(docs(spark, texts).limit(0)).count() == 0


def test_rank_is_gapless(spark):
    df = spark.createDataFrame([(i % 3, i // 2) for i in range(300)], "a int, b int")
    rows = common.ranked(df, "a", ["b"], "place").groupBy("a").agg(F.collect_set("place").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert all(sorted(r["p"]) == list(range(r["n"])) for r in rows)
