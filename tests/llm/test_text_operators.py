"""Encoding, shards, planes, decontamination and URL rules against plain Python versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from backtide.llm import bpe, decontaminate, planes, shards, urlrules

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, start=0):
    return spark.createDataFrame([(start + i, t, None, "s", None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_tree_encoder_equals_the_library(reference):
    coder, dice = bpe.codec(RANKS, public_tokenizers.PATTERN), random.Random(5)
    alphabets = ["ab", "abc \n", "the  \n\t", "éèñ ß.,", "日本語 ", "\x1c\x85 ab", "0123 ²Ⅷ", "'s't're LL' ,.", "\u0301e \u0308u", "😀👍🏽 a", "a.!? '"]
    texts = ["".join(dice.choice(dice.choice(alphabets)) for _ in range(dice.randrange(80))) for _ in range(500)]
    texts += ["a" * 5000, "the" * 3000, "".join(dice.choice("abcdefgh") for _ in range(9000)), "", " ", "<|endoftext|>"]
    for text in texts:
        ids = np.frombuffer(coder.encode(text), "<i4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_join_is_associative():
    coder, dice = bpe.codec(RANKS, public_tokenizers.PATTERN), random.Random(6)
    for _ in range(200):
        text = bytes(dice.choice(b"aabeghinorst") for _ in range(dice.randrange(3, 60)))
        cut = dice.randrange(1, len(text))
        assert coder.join(coder._tree(text[:cut]), coder._tree(text[cut:])) == coder._tree(text) == coder.merge(text) == coder._merge_long(text)


def test_encode_documents(spark, reference):
    texts = ["Hello world, hello!", None, "", "x" * 20000, "Hello world, hello!"]
    rows = bpe.encode_documents(docs(spark, *texts).withColumn("ids", F.lit("clash")), RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [reference.encode_ordinary(t or "") for t in texts]
    assert [bytes(r.decoded).decode() for r in rows] == [t or "" for t in texts]
    assert bpe.encode_documents(docs(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_shards(spark):
    dice = random.Random(7)
    texts = [None, ""] + ["é" * dice.randrange(40) for _ in range(300)] + ["x" * 500]
    table = docs(spark, *texts).union(docs(spark, "again", "again")).withColumn("size", F.lit("clash"))
    rows = shards.shard_by_bytes(table, 8).orderBy("shard", "slot").collect()
    assert len(rows) == len(texts) + 2
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    for s in range(8):
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    runs = [[r.doc_id for r in run] for _, run in itertools.groupby(rows, key=lambda r: r.text_crc32)]
    assert len(runs) == len({r.text_crc32 for r in rows})  # equal texts lie together
    assert runs == sorted(runs, key=lambda run: run[0]) and all(run == sorted(run) for run in runs)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows if r.doc_id > 1)
    assert shards.shard_by_bytes(docs(spark), 8).count() == 0


def test_byte_shards_against_brute_force(spark):
    """Null and large keys, a group of more than a shard, small groups that are never cut."""
    dice, big = random.Random(17), 9007199254740993
    rows = [(None, "n"), (None, "n"), (big, "b"), (big + 2, "c" * 9), (big + 2, "c" * 9)] + [(i, "hot " * 5) for i in range(0, 400, 2)]
    rows += [(i, "word " * dice.randrange(1, 60) + str(dice.randrange(90))) for i in range(1, 400, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    size, digest = lambda t: len(t) + 16, lambda t: hashlib.sha256(t.encode()).digest()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    small = lambda i: -1 if i is None else i
    key = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    order = sorted(rows, key=lambda r: (small(key[r[1]]), digest(r[1]), small(r[0])))
    total, at, begun, expected, slots = sum(size(t) for _, t in rows), 0, {}, [], {}
    for i, t in order:
        begun.setdefault(t, at)
        whole = size(t) * len(groups[t])
        twice = 2 * begun[t] + whole if whole <= int(shards.WHOLE * total / 12) else 2 * at + size(t)
        shard = min(11, twice * 12 // (2 * total))
        expected.append((i, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size(t)
    got = sorted(((r.doc_id, r.shard, r.slot) for r in shards.shard_by_bytes(table, 12).collect()), key=lambda r: (r[1], r[2]))
    assert got == expected


def test_words_reach_the_model_in_lower_case_once():
    words, seen = planes.WordEncoder(WORDS), []
    whole = words.tokenizer.encode
    model = words.model

    class Counted:
        def tokenize(self, word):
            seen.append(word)
            return model.tokenize(word)

    words.model = Counted()
    text = "house House HOUSE. house, Élan élan! ÉLAN Straße STRASSE\nhouse;: don't Don't ."
    for text in (text, "House house. HOUSE, hOUSE", "\u0130stanbul \u03a3\u03a3 ISTANBUL"):
        assert words.encode(text, 1) == np.array([*whole(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert len(seen) == len(set(seen)) and {"house", "strasse", "istanbul"} <= set(seen)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for n in (0, 1, 7, 64, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, "u4")
        assert (planes.from_planes(planes.to_planes(ids, 64, kind), n, 64, kind) == ids).all()


def test_plane_file(spark, tmp_path):
    texts = ["Some words, here.", None, "", "It's ÉCOLE straße.&&& don't\n<|endoftext|> 12 x", "word " * 3000, "naïve—dash…", "ΣΑΣ İ ǅ"]
    path, tokenizer, start = str(tmp_path / "ids"), Tokenizer.from_file(WORDS), 0
    planes.write_planes(docs(spark, *texts), path, WORDS, end=1, chunk=500, block=64, kind="bit")
    rows = {r.key: r for r in planes.read_planes(spark, path).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert rows[i].start == start and np.frombuffer(rows[i].ids, "<u4").tolist() == ids
        start += len(ids)
    assert planes.read_index(spark, path).agg(F.sum("n_ids")).first()[0] == start
    planes.write_planes(docs(spark), str(tmp_path / "none"), WORDS)
    assert planes.read_planes(spark, str(tmp_path / "none")).count() == 0


def edit_distance(window, text):
    """Least edit distance of window to any substring of text, without any band."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        above, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            above, row[j] = row[j], min(above + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_banded_alignment():
    dice = random.Random(8)
    for _ in range(300):
        window = bytes(dice.choice(b"abcd") for _ in range(20))
        text = bytearray(window)
        for _ in range(dice.randrange(6)):
            text[dice.randrange(len(text))] = dice.choice(b"abcd")
        text = bytes(dice.choice(b"abcd") for _ in range(4)) + bytes(text) + bytes(dice.choice(b"abcd") for _ in range(4))
        exact, found = edit_distance(window, text), decontaminate.banded_distance(window, text, 8)
        assert (found is not None and found[0] == exact) if exact <= 4 else True


def test_leaks(spark):
    dice = random.Random(9)
    word = lambda: "".join(dice.choice("abcdefghijklmnoprstu") for _ in range(dice.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(30), prose(60), "tiny", None]
    noisy = items[1].upper().replace(" ", "!! ")
    edited = items[0][:40] + "zq" + items[0][41:]
    texts = [prose(50) + " " + items[0] + " " + prose(40), prose(300), noisy, prose(20) + edited, items[0], None, "", "tiny", items[0][: len(items[0]) // 4]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(docs(spark, *texts), bench).collect()}
    assert set(got) == {(0, 0), (2, 1), (3, 0), (4, 0), (7, 2)}  # a short item counts where it is the whole document
    kept = decontaminate.without_leaks(docs(spark, *texts), decontaminate.leaks(docs(spark, *texts), bench))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 8]
    assert decontaminate.leaks(docs(spark), bench).count() == 0
    assert decontaminate.leaks(docs(spark, *texts), bench.limit(0)).count() == 0


def test_short_passages_are_found_wherever_they_lie(spark):
    dice = random.Random(10)
    prose = lambda n: " ".join("".join(dice.choice("abcdefghijklmnoprstu") for _ in range(dice.randrange(2, 9))) for _ in range(n))
    item, cjk, short = prose(60), "".join(chr(0x4E00 + dice.randrange(5000)) for _ in range(90)), "name two rivers"
    words = item.split()
    texts = [prose(20) + " " + " ".join(words[i : i + 13]) + " " + prose(20) for i in range(len(words) - 12)]
    texts += [prose(20) + " " + cjk[i : i + 30] for i in range(61)] + [prose(9) + " Name two rivers! " + prose(9), short, "re" + short, short + "ide", prose(300)]
    bench = spark.createDataFrame([(0, item), (1, cjk), (2, short)], "item_id long, text string")
    n, m = len(words) - 12, len(words) + 49
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, *texts), bench).collect()}
    assert got == {(i, 0) for i in range(n)} | {(i, 1) for i in range(n, m)} | {(m, 2), (m + 1, 2)}


def test_leaks_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"benchmark item number {i} about things of kind {i * 7919}") for i in range(6)], "item_id long, text string")
    table = docs(spark, *[r.text for r in bench.orderBy("item_id").collect()])
    whole = sorted(map(tuple, decontaminate.leaks(table, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 80)
    assert sorted(map(tuple, decontaminate.leaks(table, bench).collect())) == whole
    assert {(a, a) for a in range(6)} <= {r[:2] for r in whole}


def test_leaks_in_segments_and_ranges(monkeypatch):
    dice = random.Random(12)
    word = lambda: "".join(dice.choice("abcde") for _ in range(dice.randrange(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n)).encode()
    items = [(i, prose(40)) for i in range(6)] + [(6, b"the same again " * 12), (7, b"the same again " * 20)]
    texts = [prose(200) + b" " + items[i % 8][1] + b" " + prose(100) for i in range(12)] + [b"the same again " * 90, prose(3000) + b" " + items[2][1]]
    index = decontaminate.WindowIndex(items, 80, 0.06, 10, 30, 13)
    whole = sorted(index.search(texts))
    assert {(i, i % 8) for i in range(12)} | {(12, 6), (12, 7), (13, 2)} <= {r[:2] for r in whole}
    monkeypatch.setattr(decontaminate, "SEGMENT", 300)
    assert sorted(index.search(texts)) == whole
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert sorted(index.search(texts)) == whole


def test_leaks_of_odd_tables(spark):
    item = "a question about the height of seven mountains in the north of the country"
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "")], "item_id long, text string")
    table = spark.createDataFrame([(None, item, 5), (4, "so. " * 5000 + item, 6), (4, item, 7)], "doc_id long, text string, item_id long")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (None, 4, 4) for i in (1, 1, None)], key=str)
    kept = decontaminate.without_leaks(table, decontaminate.leaks(table, bench))
    assert [(r.doc_id, r.item_id) for r in kept.collect()] == [(None, 5)]


def test_mined_rules_against_brute_force(spark):
    """All rules of up to three tokens by counting combinations; URLs with very many tokens in common mine in bounded time."""
    dice, rows = random.Random(21), []
    for _ in range(300):
        tokens = sorted(t for t in "abcdef" if dice.random() < 0.5)
        rows.append((tokens, "block" if {"a", "b"} <= set(tokens) or dice.random() < 0.1 else "allow"))
    rows += [([f"s{i:02}" for i in range(40)], "block")] * 30 + [([], "block"), (["a"], None)]
    got = urlrules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), support=0.05, confidence=0.7).collect()
    kept = brute_rules(rows, "abcdef", 0.05, 0.7)
    own = {(tuple(r.tokens), r.label): r.confidence for r in got if not r.tokens[0].startswith("s")}
    assert own == pytest.approx(kept) and kept
    assert {len(r.tokens) for r in got if r.tokens[0].startswith("s")} == {1} and len(got) < 100


def brute_rules(rows, tokens, support, confidence):
    used = [(set(t), label) for t, label in rows if t and label]
    rules = {}
    for n in (1, 2, 3):
        for part in itertools.combinations(tokens, n):
            for label in ("allow", "block"):
                has, both = sum(set(part) <= t for t, _ in used), sum(set(part) <= t and x == label for t, x in used)
                if both >= support * len(used) and both / has >= confidence:
                    rules[part, label] = both / has
    return {k: c for k, c in rules.items() if not any(x == k[1] and set(p) < set(k[0]) and c2 >= c for (p, x), c2 in rules.items())}


def test_rules_of_urls_with_many_frequent_tokens(spark):
    """Most URLs have more frequent tokens than FP-growth is given; what tells may be any of them."""
    dice, rows, names = random.Random(4), [], [f"t{i:02}" for i in range(18)]
    for i in range(400):
        tokens = [t for t in names if dice.random() < (0.85 if i % 4 else 0.4)]
        evil = {"t03", "t17"} <= set(tokens) and "t09" not in tokens
        rows.append((tokens, "block" if evil or dice.random() < 0.05 else "allow"))
    rows += [([*names, "evil"], "block")] * 60
    assert sum(len(t) > urlrules.BASKET for t, _ in rows) > 200
    table = spark.createDataFrame(rows, "tokens array<string>, label string").repartition(3)
    got = {(tuple(r.tokens), r.label): (r.confidence, r.support) for r in urlrules.mine_rules(table, support=0.05, confidence=0.7).collect()}
    want = brute_rules(rows, ["evil", *names], 0.05, 0.7)
    assert {k: c for k, (c, _) in got.items()} == pytest.approx(want) and (("evil",), "block") in got
    assert got[("evil",), "block"][1] == pytest.approx(60 / 460)
    clash = spark.createDataFrame([(1, ["evil", "x"], "mine", "k"), (2, None, "own", "k")], "rank int, tokens array<string>, label string, key_token string")
    rules = urlrules.mine_rules(table, support=0.05, confidence=0.7)
    assert [(r.rank, r.label, r.key_token, r.best and r.best.label) for r in urlrules.match_rules(clash, rules).orderBy("rank").collect()] == [(1, "mine", "k", "block"), (2, "own", "k", None)]


@pytest.mark.parametrize("rows, tokens", [(150_000, 8), (10_000, 14)])
def test_labelled_urls_of_few_tokens_are_not_broadcast(spark, rows, tokens):
    """Files of few different tokens are small; in memory rows, and pairs of URLs with many tokens, outgrow what may be broadcast."""
    name = lambda i: F.concat(F.lit(f"path:one-of-{i + 2}-tokens-that-stand-here-"), F.col("id") % (i + 2))
    label = F.when(F.col("id") % 3 == 0, "block").otherwise("allow")
    table = spark.range(rows).select(F.array(*map(name, range(tokens))).alias("tokens"), label.alias("label"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100m")
    try:
        got = {(*r.tokens, r.label): r.confidence for r in urlrules.mine_rules(table).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert all(got[f"path:one-of-3-tokens-that-stand-here-{n}", label] == 1 for n, label in enumerate(("block", "allow", "allow")))


def test_listed_url_rules(spark):
    urls = ["http://a.Example.ORG/es/1", "https://example.org/en/12", "http://x.org", "http://x.org/", "http://fr.com/fr/9?x#y", "http://www.z.com/de/", "nothing", None, "a://b://c/d", "http://notorg/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    none = spark.createDataFrame([], "tokens array<string>, label string")
    rows = urlrules.judge_urls(pages, urlrules.mine_rules(none)).orderBy("page_id").collect()
    assert [r.rule for r in rows] == ["example.org/es/", "example.org/en/1", None, "org/", "com/fr/", "com/de/", None, None, None, None]
    assert [r.verdict for r in rows][:6] == ["block", "block", "allow", "allow", "allow", "block"]
    assert [(r.host, r.path) for r in rows][4:9] == [("fr.com", "/fr/9"), ("www.z.com", "/de/"), ("", ""), ("", ""), ("b:", "//c/d")]


def test_mined_url_rules(spark):
    urls = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.example.net/en/{i}") for i in range(60)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labelled = pages.select(urlrules.url_tokens(F.col("url")).alias("tokens"), F.when(F.col("page_id") % 3 == 0, "block").otherwise("allow").alias("label"))
    rows = urlrules.judge_urls(pages.union(pages), urlrules.mine_rules(labelled)).collect()
    assert len(rows) == 120 and all(r.verdict == ("block" if r.page_id % 3 == 0 else "allow") for r in rows)
