"""Every training-data operator on small tables: brute force, exact round trips, and the odd cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.llm import additive, bpe, chat, decontam, labelled, line_dedup, neardup, packing, queries, rules, secret_scan, statistics, tokens, toxicity
from loopweave.llm.common import components, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, white space, repeated rows, null id, text beyond ASCII, one long text.
LONG = " ".join(f"word{k % 997} and" for k in range(20_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (None, "no id at all"), (5, "Größe 世界 🙂 \x1c x"), (6, LONG), (7, "one two three")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns that are named as operators name theirs."""
    names = ["id", "score", "kept", "n_words", "n", "value", "component", "blob", "spans", "content", "_covered", "lines", "piece", "length", "salt", "held_out", "key", "k1"]
    return odd.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(200)] + [(3, None, None), (None, 1, 1), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")


def made(spark, n=200, seed=0):
    """Documents of two kinds: odd ids are plain, even ids shout and hold one of three rude words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "to", "ri", "el", "mos", "ta"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 120))]
        if k % 2 == 0:
            words = [w + "###" for w in words]
            for rude in ("grobian", "dumpfbak", "flegelig"):
                words[rng.randrange(len(words))] = rude
        rows.append((k, " ".join(words), "x", "s", 0))
    return spark.createDataFrame(rows, DOCS)


def by_id(df, *names):
    return sorted(([r[n] for n in names] for r in df.collect()), key=str)


# --- statistics, 1, 2 ------------------------------------------------------------------------------------------------------


def test_statistics_against_their_definition():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "a ", "b ", " ", "\n", "\t", "#", "é ", "\x1c", "\x85", "|"]) for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert statistics.base(text.encode()) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)), text


def test_additive_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(3 * np.sin(x[:, 0]) + 4 * x[:, 1] * x[:, 2])))).astype(float)
    model = additive.fit(x[:2000], y[:2000])
    assert {(f, g) for f, g, _ in model.pairs} >= {(1, 2)}
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.8
    assert additive.fit(np.empty((0, 0)), np.empty(0)).intercept == 0


def test_forest_is_monotone_and_right():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 0.9 * (x[:, 0] < 0.5) + 0.05 + 0.05 * np.sin(20 * x[:, 0])).astype(float)
    forest = rules.fit(x, y, {0: -1})
    grid = np.stack([np.linspace(0, 1, 400), np.full(400, 0.3), np.full(400, 0.7)], 1)
    assert (np.diff(forest.score(grid)) <= 1e-12).all() and forest.score(grid)[0] > 0.8 > 0.2 > forest.score(grid)[-1]
    free = rules.fit(x, y, {})
    assert (np.diff(free.score(grid)) > 0).any()
    assert rules.fit(np.empty((0, 3)), np.empty(0), {}) is None and rules.fit(x[:5], np.ones(5), {}) is None


def test_quality(spark, labels):
    docs = made(spark)
    got = {r.doc_id: r for r in additive.quality_scores(docs, labels).collect()}
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k, r in got.items() if r.held_out} == set(held)
    assert all(got[k].predicted == k % 2 for k in held) and all(0 <= r.score <= 1 for r in got.values())
    judged = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    assert all(judged[k].kept == (k % 2 == 1) for k in held)
    kept = rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in judged.items() if r.kept}


def test_quality_scores_by_hand(spark):
    """A score is the intercept and one entry of each table, looked up a document at a time. Some labels are noise, so pairs have gains."""
    docs, rng = made(spark), random.Random(3)
    labels = spark.createDataFrame([(k, k % 2 if rng.random() < 0.7 else rng.randint(0, 1)) for k in range(200)], "doc_id long, quality int")
    x, y = additive.feature_table(labelled.training_rows(docs, labels, "quality", 20_000))
    model = additive.fit(x, y)
    assert model.pairs
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in additive.quality_scores(docs, labels).collect():
        values = statistics.features(texts[r.doc_id].encode())[1]
        bins = [sum(v > e for e in edges) for v, edges in zip(values, model.edges, strict=True)]
        raw = model.intercept + sum(float(t[b]) for t, b in zip(model.tables, bins, strict=True))
        for f, g, t in model.pairs:
            raw += float(t[model.coarse[f][bins[f]]][model.coarse[g][bins[g]]])
        want = 1 / (1 + math.exp(-raw))
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.3)


def test_quality_rules_by_hand(spark, labels):
    """``kept``: the base rules, then each tree walked from its root, a node at a time. Some documents are short or repeat themselves."""
    docs = made(spark).union(spark.createDataFrame([(500, "a few words", "x", "s", 0), (501, "one two three four " * 30, "x", "s", 0), (502, "", "x", "s", 0)], DOCS))
    forest = rules.trained(docs, labels)

    def walk(node, values):
        while forest.left[node] != node:
            node = forest.left[node] if values[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        return float(forest.value[node])

    texts, seen = {r.doc_id: r.text for r in docs.collect()}, Counter()
    for r in rules.quality_rules(docs, labels).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        values = statistics.features(texts[r.doc_id].encode())[1]
        score = 1 / (1 + math.exp(-(forest.intercept + sum(walk(root, values) for root in forest.roots))))
        assert r.score == pytest.approx(score, abs=1e-9) and r.base_failed == failed and r.kept == (not failed and score >= 0.3)
        seen[failed, r.kept] += 1
    assert seen[True, False] == 3 and seen[False, True] and seen[False, False]


@pytest.mark.parametrize("run", [
    lambda d, x: additive.quality_scores(d, x), lambda d, x: rules.quality_rules(d, x), lambda d, x: toxicity.toxicity_scores(d, x), lambda d, x: tokens.token_counts(d, queries.vocabulary()),
    lambda d, x: decontam.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d, x: secret_scan.digests(secret_scan.scan(d)[0]), lambda d, x: line_dedup.digests(line_dedup.deduplicated(d)),
    lambda d, x: neardup.near_duplicates(d, 3, 85), lambda d, x: packing.packed(d, queries.vocabulary()),
])
def test_odd_tables(odd, empty, clashing, labels, run):
    rows = [tuple(r) for r in run(odd, labels).collect()]
    ids = Counter(r[0] for r in rows)
    assert set(ids) == {r[0] for r in ODD} and ids[4] == 2 and ids[1] == 1
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in run(clashing, labels).collect())
    assert run(empty, labels).collect() == []
    assert run(odd, labels.limit(0)).count() == len(rows)


def test_training_rows_are_bounded_by_rows(spark, labels):
    docs = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).union(spark.createDataFrame([(8, "b"), (11, "c")], "doc_id long, text string"))
    rows = labelled.training_rows(docs, labels, "quality", 100).collect()
    assert len({r.id for r in rows}) == len(rows) <= 3 and {r.id for r in rows} >= {7}
    again = labelled.training_rows(docs.repartition(7), labels, "quality", 100).collect()
    assert sorted((r.id, bytes(r.text)) for r in again) == sorted((r.id, bytes(r.text)) for r in rows)


# --- 3 ------------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["### ", "Assistant: ", "<turn>", "</turn>", "\\", "\n", ":", "#", "<", "ok ", "é", "🙂", "$1", "\\\\1"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "a:#<\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, None, None), (100, 0, None, None), (100, None, "user", "first"), (None, 1, "user", "x"), (101, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("starts", F.lit(1))
    formatted = chat.format_conversations(df)
    want = defaultdict(list)
    for c, _t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss, r.formatted) for r in chat.read_back(formatted).collect()}
    assert {c: t for c, (t, _, _) in back.items()} == dict(want)
    assert all(loss == [x for r, x in want[c] if r == "assistant"] for c, (_, loss, _) in back.items())
    for c, (_, _, text) in back.items():  # adjacent turns of a role share one header
        assert len(re.findall(r"(?:^|\n)### ", re.sub(r"(?s)<turn>(?:[^\\<#:]|\\.)*</turn>", "", text))) == 1 + sum(a[0] != b[0] for a, b in zip(want[c], want[c][1:], strict=False))
    for r in formatted.collect():  # the mask covers the escaped texts, as they stand in the formatted one
        at, masked = 0, []
        for m in r.loss_mask:
            text = r.formatted[at + m.skip : at + m.skip + m.take]
            at += m.skip + m.take
            if m.learn:
                masked.append(re.sub(r"(?s)\\(.)", r"\1", text))
        assert masked == [x for role, x in want[r.conv_id] if role == "assistant"] and r.formatted[at:] == chat.CLOSE + chat.END
    wrong = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.struct(m["skip"].alias("skip"), (m["take"] + 1).alias("take"), m["learn"].alias("learn"))))
    with pytest.raises(Exception, match="mask does not fit"):
        chat.read_back(wrong).collect()
    digest = {r.conv_id: r for r in chat.turn_digests(formatted).collect()}
    assert digest[101].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and digest[100].n_turns == 3
    assert chat.turn_digests(chat.format_conversations(df.limit(0))).collect() == []


# --- 4 ------------------------------------------------------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["The", "a", "of", "é", "x1", "b-c"]) for _ in range(n))
    items = [(k, some(rng.choice([1, 2, 3, 9, 10, 14, 30]))) for k in range(12)] + [(50, None), (51, "!!"), (None, some(12)), (3, some(11))]
    docs = [(k, some(rng.randint(0, 60)) + " " + (items[k % 12][1] or "")[: rng.randint(0, 60)] + " " + some(8)) for k in range(40)] + [(90, None), (91, ""), (91, "")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    want = []
    for i, t in docs:
        w, hit, who = word(low(t)), set(), set()
        for item, x in items:
            v = word(low(x))
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit |= set(range(at, at + n))
                        who.add("" if item is None else str(item))
        want.append([i, len(w), len(hit), sorted(who)])
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontam.BROADCAST_BYTES, 0):
        assert by_id(decontam.contamination(d, b, broadcast_bytes=bound), "doc_id", "n_words", "n_hit", "items") == sorted(want, key=str)
    clean = decontam.clean_documents(d.withColumn("_key", F.lit(1)), b.where("item_id = 51"))
    assert clean.count() == len(docs)


# --- 5 ------------------------------------------------------------------------------------------------------------------------


def spans_by_hand(text):
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)]


def test_secret_scan_against_re(spark, monkeypatch):
    rng = random.Random(4)
    bits = ["password", "PassWD", " = ", ":", "'", '"', "secret", "token", "Api_Key", "apikey", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "🙂", " ", "\n", "é", "x", "=="]
    docs = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(300)]
    docs += [(400, None), (401, "token: api_key: abcdefgh12"), (402, "ghp_" + "z1" * 18), (403, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    findings, ledger = secret_scan.scan(df)
    got = {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.spans if s.kind in secret_scan.BASE) for r in findings.collect()}
    assert got == {i: sorted(spans_by_hand(t or "")) for i, t in docs}
    assert {r.doc_id: r.spans for r in secret_scan.digests(findings).collect()}[402] == "github:0:40"
    assert ledger.count() == len({t or "" for _, t in docs})
    more = df.union(spark.createDataFrame([(500, "secret=zzzzzzzzzz"), (501, docs[5][1])], "doc_id long, text string"))
    again, fresh = secret_scan.scan(more, ledger)
    assert fresh.count() == 1 and again.count() == len(docs) + 2
    assert {r.doc_id: r.blob for r in again.collect()}[501] == {r.doc_id: r.blob for r in findings.collect()}[5]
    assert {r.doc_id: len(r.spans) for r in again.collect()}[5] == len(got[5])
    assert secret_scan.scan(df, ledger, rule_version=2)[1].count() == ledger.count()
    monkeypatch.setattr(secret_scan, "BROADCAST_BLOBS", 0)
    joined, alike = secret_scan.scan(more, ledger)
    assert sorted(joined.collect(), key=str) == sorted(again.collect(), key=str) and alike.collect() == fresh.collect()


def test_many_matches_take_linear_time(spark):
    import time

    text = "\n".join(f"token=abcdefgh{k:06d}" for k in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "x " * 2_000_000 + "AKIA" + "Z" * 16), (3, "")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(df)[0]).collect()}
    assert time.time() - began < 20  # a fold that copies what it has took 48 s
    assert got[1].n_assign == 40_000 and got[1].spans.endswith(f"assign:{len(text) - 20}:{len(text)}") and got[2].spans == "access:4000000:4000020" and got[3].spans == ""


def test_a_scan_runs_in_the_jvm(spark):
    plan = secret_scan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 6 ------------------------------------------------------------------------------------------------------------------------


def deduplicated_by_hand(docs):
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    seen, out = {}, []
    for i, t in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if trim(x)]
        width, gone = min(3, len(full)), set()
        for j in range(len(full) - width + 1) if full else ():
            key = (len(full) < 3, tuple(trim(lines[k]) for k in full[j : j + width]))
            if key in seen:
                gone |= set(full[j : j + width])
            seen.setdefault(key, (i, j))
        text = t if not gone else "" if len(gone) == len(full) else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append([i, text, len(full), len(gone)])
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(k, "\n".join(rng.choice(["a", " a", "b", "c", "", "  ", "d\t"]) for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(90, None), (91, "z\nz\nz\nz\nz"), (92, LONG)]
    want = sorted(deduplicated_by_hand(docs), key=str)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("_h1", F.lit(2)).withColumn("_result", F.lit(3))
    out = line_dedup.deduplicated(df)
    assert by_id(out, "doc_id", "text", "_n_lines", "_n_removed") == want
    assert out.columns == [*df.columns, "_n_lines", "_n_removed"]
    assert by_id(line_dedup.deduplicated(df.union(df)), "doc_id", "text") == sorted([w[:2] for w in want] * 2, key=str)


# --- 7, 10 --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def strange(rng):
    letters = ["a", "the", "Ing", "é", "ß", "ª", "²", "\x85", "\xa0", " ", "  ", "\n", "\t", "\x1c", "'", "'s", "'LL", "<|endoftext|>", "<|", "#", "世", "🙂", "٣", "œ", "_", "-", "007", "\x00"]
    return "".join(rng.choice(letters[: rng.choice([10, 18, 28])]) for _ in range(rng.randint(0, 30)))


def test_encoder_is_the_library(library):
    with open(queries.vocabulary(), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read(), tuple, lambda parts: [i for p in parts for i in p])
    rng = random.Random(6)
    for text in [strange(rng) for _ in range(3000)] + [LONG]:
        assert encoder(text) == library.encode(text, add_special_tokens=False).ids, text
    assert len(encoder.known.whole) > 40_000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, name):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path) if name.endswith("json") else sentencepiece.SentencePieceProcessor(model_file=path)
    size = lambda t: len(own.encode(t, add_special_tokens=False).ids if name.endswith("json") else own.encode(t))
    assert by_id(tokens.token_counts(odd, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(([i, len((t or "").encode()), size(t or ""), size(t or "") > 512] for i, t in ODD), key=str)


def test_packing_is_whole(spark, odd, library):
    docs = odd.union(made(spark, 60)).union(spark.createDataFrame([(900, LONG, None, None, None)], DOCS)).where("doc_id is not null")
    rows = packing.packed(docs, queries.vocabulary()).collect()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    for r in rows:
        assert any(len(x) >= r.start + r.length and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    pieces = [r for r in rows if r.doc_id == 900]
    assert sorted(r.piece for r in pieces) == list(range(len(pieces))) and all(r.length == 2048 for r in pieces if r.piece)


def least_bins(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in {free: n for n, free in enumerate(bins) if free >= items[k]}.values():
            bins[b] -= items[k]
            put(k + 1, bins)
            bins[b] += items[k]
        put(k + 1, [*bins, capacity - items[k]])

    put(0, [])
    return best


def test_dominance_keeps_the_optimum():
    rng = random.Random(7)
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 8))]
        runs = packing.Runs(Counter(items))
        packing.reduce_by_dominance(runs, capacity)
        assert runs.next + least_bins(list(runs.left.elements()), capacity) == least_bins(items, capacity), (capacity, items)
        rows, n, _ = packing.pack(Counter(items), capacity)
        assert sum(r[2] for r in rows) == len(items) and n >= least_bins(items, capacity)


def test_packing_is_near_the_least_number():
    """At most one sequence more than the least possible, and no more in nineteen cases of twenty."""
    rng, exact = random.Random(11), 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, capacity if rng.random() < 0.5 else capacity // 2) for _ in range(rng.randint(1, 10))]
        n, least = packing.pack(Counter(items), capacity)[1], least_bins(items, capacity)
        assert least <= n <= least + 1, (capacity, items)
        exact += n == least
    assert exact >= 285


# --- 8 ------------------------------------------------------------------------------------------------------------------------


def groups_by_hand(docs, width, similar):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    own = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= similar * len(sets[a] | sets[b]) and own[a] != own[b]:
                lo, hi = sorted((own[a], own[b]))
                own = {k: lo if v == hi else v for k, v in own.items()}
    return {i: (len(s), own[i]) for i, s in sets.items()}


@pytest.mark.parametrize("width,similar", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, similar, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = some(60)
    docs = []
    for size in (5, 30, 120):  # families of copies with more and more edits, and texts around one shared passage
        base = some(size)
        for edits in range(30):
            w = list(base)
            for _ in range(edits % 9):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w).upper() if edits % 5 == 0 else "  ".join(w))
    docs += [" ".join(some(20) + shared + some(10)) for _ in range(40)] + [" ".join(some(rng.randint(1, 4))) for _ in range(20)] + ["", None, " \n"]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    want = groups_by_hand(rows, width, similar)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 8):  # blocks of a list, and pairs of blocks
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width, similar).collect()}
        assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    one = neardup.one_of_each(df.withColumn("id", F.lit(1)), width, similar)
    assert one.columns == ["doc_id", "text", "id"] and {r.doc_id for r in one.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_of_one_id(spark):
    """Rows of one id are one node: 2 ties the class of 1 and the class of 9."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(2, a), (2, b), (1, a), (9, b), (None, a), (5, "x")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 3, 85).collect()), key=str) == sorted([(2, 1, False), (2, 1, False), (1, 1, True), (9, 1, False), (None, None, True), (5, 5, True)], key=str)


def test_near_duplicates_need_integer_ids(spark):
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_operators_leave_their_results_only(spark):
    folder = shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(folder))
    docs = made(spark, 60)
    out = neardup.near_duplicates(docs)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() == 60
    decontam.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(3), broadcast_bytes=0).count()
    assert len(set(os.listdir(folder)) - before) == 2
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert spark.conf.get(key) == "10000"


def test_bounds():
    from math import comb

    for k, t in ((64, 0.85), (32, 0.85), (64, 0.8), (32, 0.5)):
        c = neardup.least_common(k, t)
        miss = sum(comb(k, i) * t**i * (1 - t) ** (k - i) for i in range(c))
        assert miss <= neardup.MISS < miss + comb(k, c) * t**c * (1 - t) ** (k - c)


def test_long_words_and_texts_hash_alike():
    assert neardup.Shingler(3).sets([]) == []
    texts = [b"a" * 3_000_000 + b" b c", b"", b"x y z", LONG.encode()]
    whole = neardup.Shingler(3)
    parts = neardup.Shingler(3)
    parts.STRIDE = 64
    assert all((a == b).all() for a, b in zip(whole.sets(texts), parts.sets(texts), strict=True))


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500), (None, 3)]
    own = {k: k for e in edges for k in e if k is not None and e[0] != e[1] and None not in e}
    for a, b in edges:
        if a in own and b in own:
            lo, hi = sorted((own[a], own[b]))
            own = {k: lo if v == hi else v for k, v in own.items()}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == own


# --- 9 ------------------------------------------------------------------------------------------------------------------------


def kernel_by_hand(a, b):
    def vector(s):
        from itertools import combinations

        out = Counter()
        for c in combinations(range(len(s)), toxicity.LETTERS):
            if c[-1] - c[0] < toxicity.SPAN:
                out["".join(s[k] for k in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    x, y = vector(a), vector(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_against_its_definition():
    words = [toxicity.stretches(w)[0] for w in ("idiot", "idioot", "id-iot", "banana", "ananas", "wetter")]
    got = toxicity.Landmarks(words, 1).kernel(words)
    want = np.array([[kernel_by_hand(a, b) for b in words] for a in words]) ** toxicity.POWER
    assert np.allclose(got, want, atol=1e-4)
    assert got[0, 1] > 5 * got[0, 5]


def test_units():
    assert toxicity.units("Du I.D.I.O.T!! i d i o t a b") >= {"idiot", "idiotab", "du"}
    assert toxicity.units("") == set()


def test_toxicity(spark, labels):
    docs = made(spark)
    model = toxicity.trained(docs, labels)
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels, model=model).collect()}
    assert np.mean([got[k].predicted == 1 - k % 2 for k in held]) == 1
    disguised = spark.createDataFrame([(k, f"tanmos el {w} toan ri eltoan") for k, w in enumerate(["g.r.o.b.i.a.n", "grobbian", "flegeliig", "tanrimos"])], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.toxicity_scores(disguised, labels, model=model).collect()}
    assert min(score[0], score[1], score[2]) > 2 * score[3]
    assert toxicity.trained(docs, labels.where("toxic = 0")) is None


def test_scores_do_not_fall_with_length(spark, labels):
    """A toxic text that is followed by any number of clean ones scores as it does alone, or higher."""
    docs = made(spark)
    model = toxicity.trained(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = " ".join(texts[k] for k in range(1, 200, 2))
    rude = "so ein grobian steht hier."
    longer = [" ".join([rude, *clean.split()[:n]]) for n in (0, 50, 500, 5_000)]
    rows = [(k, t, "", "", 0) for k, t in enumerate([*longer, clean])]
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.toxicity_scores(spark.createDataFrame(rows, DOCS), labels, model=model).collect()}
    assert [got[k][1] for k in range(5)] == [1, 1, 1, 1, 0] and min(got[k][0] for k in range(4)) >= got[0][0] - 1e-9


def test_altered_words_reach_the_machine():
    model = toxicity.train_words(dict.fromkeys(("trash", "moron", "idiot"), 5), dict.fromkeys(("wetter", "banana", "ananas", "tanmos", "eltoan"), 5))
    altered = ["txr1ash", "mxor1on", "ixd1iot", "superidiotface"]
    want = [max(model.landmarks.kernel(toxicity.stretches(w)) @ model.weights) + model.bias for w in altered]
    assert np.allclose(model.words(altered), want) and min(want) > model.bias + 1e-4


def invented(n, seed):
    rng = random.Random(seed)
    return list(dict.fromkeys("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)))


def test_every_learnt_word_is_a_landmark(monkeypatch):
    toxic, clean = invented(450, 1), invented(300, 2)
    for most in (toxicity.POSITIVES, 200):
        monkeypatch.setattr(toxicity, "POSITIVES", most)
        model = toxicity.train_words(dict.fromkeys(toxic, 5), dict.fromkeys(clean, 5))
        value = model.words([*toxic, *clean])
        assert min(value[: len(toxic)]) > 0 > max(value[len(toxic) :])
        assert len(model.more) == (2 if most == 200 else 0)


def full_kernel_machine(parts, y, weight, cost=100.0):
    """Squared hinge in the kernel's own space, without landmarks: on the active set (K + 1 / (2 C w)) beta = y, where the bias is
    one more constant in the kernel."""
    k = toxicity.Landmarks(parts, 1).kernel(parts) + 1e3
    on, beta = np.ones(len(y), bool), np.zeros(len(y))
    for _ in range(200):
        beta = np.zeros(len(y))
        beta[on] = np.linalg.solve(k[np.ix_(on, on)] + np.diag(1 / (2 * cost * weight[on])), y[on])
        now = y * (k @ beta) < 1
        if (now == on).all():
            return k @ beta
        on = now
    raise AssertionError("no active set")


def test_machine_against_the_full_kernel(monkeypatch):
    """With every instance a landmark the Nyström map is exact, so the scores are those of the full kernel's machine."""
    monkeypatch.setattr(toxicity, "_disguised", lambda w: [])
    monkeypatch.setattr(toxicity, "LANDMARKS", 10_000)
    toxic, clean = invented(25, 1), [*invented(60, 2), "a" * 40]
    model = toxicity.train_words(dict.fromkeys(toxic, 3), dict.fromkeys(clean, 2))
    parts = [(p, 1.0, 3.0) for w in toxic for p in toxicity.stretches(w)] + [(p, -1.0, 2.0) for w in clean for p in toxicity.stretches(w)]
    want = full_kernel_machine([p[0] for p in parts], np.array([p[1] for p in parts]), np.sqrt(np.array([p[2] for p in parts])))
    assert np.allclose(model.landmarks.kernel([p[0] for p in parts]) @ model.weights + model.bias, want, atol=1e-3)


def test_recall_by_disguise(spark, labels):
    """Spellings that training did not make: other seeds, all places."""
    model = toxicity.trained(made(spark), labels)
    rng, rude = random.Random(99), ["grobian", "dumpfbak", "flegelig"]
    put = lambda w: (lambda k: w[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") + w[k:])(rng.randint(1, len(w) - 1))
    one, two = [put(w) for w in rude for _ in range(40)], [put(put(w)) for w in rude for _ in range(80)]
    recall = [float((model.words(v) > 0).mean()) for v in (rude, one, two)]
    assert recall[0] == 1 and recall[1] >= 0.95 and recall[2] >= 0.9, recall


def test_copies_are_confirmed_before_they_go(spark):
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    base, shared = some(100), some(60)
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (0, 50)]
    texts = [" ".join(base), *near, " ".join(base), *(" ".join(shared + some(60)) for _ in range(30)), "", "a b"]
    rows = spark.createDataFrame([(k, int(k == 3), t.encode()) for k, t in enumerate(texts)], "id long, label int, text binary")
    # 1 and 2 are like 0; 3 has another label; what only shares a passage stays
    assert {r.id for r in toxicity._without_copies(rows).collect()} == set(range(len(texts))) - {1, 2}


def test_words_beyond_one_machine_are_learnt(spark, labels, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 1)
    model = toxicity.trained(made(spark), labels)
    assert min(model.words(["grobian", "dumpfbak", "flegelig"])) > 0


def test_components_do_not_stop_early(spark):
    path = spark.range(40).selectExpr("id as a", "id + 1 as b")
    with pytest.raises(RuntimeError):
        components(path, 2)
    assert {r.component for r in components(path).collect()} == {0}
