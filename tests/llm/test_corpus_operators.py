"""Fingerprints, classifiers, near copies, personal data and the pipeline."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from backtide.llm import language, neardup, pii, quality, spotsigs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def prose(dice, n):
    return " ".join("".join(dice.choice("abcdefghijklmnoprstu") for _ in range(dice.randrange(2, 9))) for _ in range(n))


# Spot signatures


def spots(text):
    words = [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (text or "").lower())]
    glued = "".join(w + ("|" if w in spotsigs.ANCHORS else " ") for w in words).split(" ")
    tokens = [t for t in glued if t]
    content = [t.rsplit("|", 1)[-1] for t in tokens]
    return {(t, *content[i + 1 : i + 3]) for i, t in enumerate(tokens) if "|" in t and i + 2 < len(tokens)}


def test_spot_sets(spark):
    texts = ["The cat of the house sat on a mat with its small friend.", "no anchors at all? none", "", None, "Die Katze und der Hund im Garten sind müde und alt geworden.", "the of and", "the cat of"]
    rows = docs(spark, *texts).select("doc_id", spotsigs.spot_set(F.col("text")).alias("s")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts):
        own = spots(text)
        assert len(r.s) == (len(own) or (1 if text else 0)) and list(r.s) == sorted(r.s)


def test_edited_texts(spark):
    dice = random.Random(1)
    texts = [prose(dice, 5) + " the " + prose(dice, 9) + " of " + prose(dice, 7), "", None, "äöü" * 5, prose(dice, 40), "a", prose(dice, 40)]
    rows = {r.doc_id: r for r in spotsigs.fingerprint_with_edits(docs(spark, *texts).withColumn("spots", F.lit("clash"))).collect()}
    order = sorted(rows, reverse=True)
    for i, d in enumerate(order):
        own, following = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(own) // 3
        assert rows[d].n_chars == len(own) and rows[d].edited == own[: len(own) - cut] + following[:cut]
        a, b = set(rows[d].spots), set(rows[d].edited_spots)
        assert rows[d].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert spotsigs.fingerprint_with_edits(docs(spark)).count() == 0
    twice = docs(spark, "the one two three").union(docs(spark, "the one two three"))
    assert spotsigs.fingerprint_with_edits(twice).count() == 2
    null_key = docs(spark, "the one two three four five").withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.near_next for r in spotsigs.fingerprint_with_edits(null_key).collect()] == [0.0]


def test_pruned_jaccard(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), ([1, 2, 3, 4], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(spotsigs.pruned_jaccard(F.col("a"), F.col("b"), 0.5)).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_fingerprints_and_likenesses_of_real_pairs(spark):
    dice, base = random.Random(3), None
    texts = []
    for i in range(30):
        words = [dice.choice(["the", "of", "and", *"kilo lima mike november oscar papa".split()]) if dice.random() < 0.4 else prose(dice, 1) for _ in range(60)]
        base = words if base is None or i % 3 == 0 else base
        texts.append(" ".join([*base[: 60 - 4 * (i % 3)], *words[60 - 4 * (i % 3) :]]))
    rows = {r.doc_id: r for r in spotsigs.fingerprint_with_edits(docs(spark, *texts)).withColumn("fingerprint", spotsigs.fingerprint(F.col("spots"))).collect()}
    sets = [spots(t) for t in texts]
    digits = {}
    for i, own in enumerate(sets):
        printed = rows[i].fingerprint
        assert len(printed) == 16 * len(own) and [int(printed[k : k + 16], 16) for k in range(0, len(printed), 16)] == [s & (1 << 64) - 1 for s in rows[i].spots]
        digits.setdefault(frozenset(own), printed)
        assert digits[frozenset(own)] == printed
        other = sets[i - 1]  # the next document in descending order; the last one before the first
        likeness = len(own & other) / len(own | other)
        assert rows[i].near_next == pytest.approx(likeness)
    pairs = {(r.a, r.b): r.likeness for r in spotsigs.spot_matches(docs(spark, *texts, texts[0], None, ""), least=0.5).collect()}
    exact = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(30) for j in range(i) if sets[i] != sets[j] and sets.index(sets[i]) == i and sets.index(sets[j]) == j}
    assert pairs == pytest.approx({k: v for k, v in exact.items() if v >= 0.5}) and len(pairs) > 5


# Near copies


def components(texts, percent=85):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_duplicates(spark):
    dice, texts = random.Random(2), [None, "", " \n", "one two", "ONE two", "one\x0btwo", "ÉA b c d e", "éa b c d e"]
    base = prose(dice, 120).split()
    for _ in range(60):  # a family with edits of all sizes
        words = list(base)
        for _ in range(dice.randrange(6)):
            words[dice.randrange(len(words))] = prose(dice, 1)
        texts.append(" ".join(words))
    texts += [prose(dice, dice.randrange(1, 60)) for _ in range(40)] + [texts[10]] * 5
    rows = neardup.near_duplicates(docs(spark, *texts).withColumn("component_id", F.lit("clash"))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_mixed_buckets(spark):
    """Documents that share most of their words, some of them links, cut up by rare shingles in every mixed bucket."""
    dice, texts = random.Random(8), []
    shared = prose(dice, 70)
    for _ in range(25):
        own = prose(dice, dice.randrange(4, 12)).split()
        texts.append(shared + " " + " ".join(own))
        texts.append(shared + " " + " ".join([*own[:-1], "other"]))
    rows = neardup.near_duplicates(docs(spark, *texts), percent=90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts, 90)


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(docs(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, None, True), (3, 3, True), (3, 3, True), (9, 3, False), (4, 4, True)], key=str)


def test_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 7), (50, 51)], "a long, b long")
    got = {r.id: r.component for r in neardup.connected(edges).collect()}
    assert got == {**dict.fromkeys([*range(41), 100], 0), 50: 50, 51: 50}


def test_chunk_keys_find_all_near_signatures():
    dice = np.random.default_rng(3)
    for _ in range(200):
        symbols = dice.integers(0, 1 << 9, neardup.SYMBOLS).astype("u8")
        other = symbols.copy()
        other[dice.choice(neardup.SYMBOLS, neardup.MAX_DISTANCE, replace=False)] ^= np.uint64(1)
        packed = [(x.reshape(neardup.CHUNKS, neardup.WIDTH) << neardup._LANES).sum(axis=1, dtype="u8").view("i8")[None] for x in (symbols, other)]
        assert set(neardup.chunk_keys(packed[0])[0]) & set(neardup.chunk_keys(packed[1])[0])


def tail(n, p, most):
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1, n + 1))


def test_sketches_lose_no_more_than_chunk_keys():
    missed_chunks = tail(neardup.WIDTH, 0.15, 1) ** neardup.CHUNKS
    assert tail(neardup.SKETCH, 0.075, neardup.SKETCH_DISTANCE) <= missed_chunks < 1e-7


def test_bounds_follow_the_threshold():
    assert neardup.bounds(85) == (neardup.CHUNKS, neardup.SKETCH_DISTANCE)
    for percent in (50, 80, 90):
        chunks, most = neardup.bounds(percent)
        p = 1 - percent / 100
        assert tail(neardup.WIDTH, p, 1) ** chunks <= 1e-7 and tail(neardup.SKETCH, p / 2, most) <= 1e-7
    with pytest.raises(ValueError, match="percent"):
        neardup.bounds(30)


def test_pipeline_drops_near_copies_from_four_fifths_on(spark):
    dice, texts = random.Random(12), []
    for _ in range(30):
        words = prose(dice, 104).split()
        other = list(words)
        for at in (20, 50) if dice.random() < 0.7 else (50,):
            other[at] = "qqqqqqqqqq"
        texts += [" ".join(words), " ".join(other)]
    expected = components(texts, 80)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs(spark, *texts), "").collect()}
    assert kept == {i for i, (_, head) in expected.items() if i == head}
    assert kept != {i for i, (_, head) in components(texts, 85).items() if i == head}


# Classifiers


def labelled(n=400):
    dice = random.Random(4)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        text = prose(dice, 30) if good else dice.choice([" ".join([w + "%%%" for w in prose(dice, 20).split()]), " ".join([prose(dice, 1)] * 20), prose(dice, 20).upper().replace(" ", "!! ")])
        rows.append((i, text, int(good)))
    return rows


def test_quality(spark):
    rows = labelled()
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit_quality(table.select("doc_id", "text"), table.select("doc_id", "quality"), sample_rows=300)
    more = table.union(spark.createDataFrame([(1000, None, None), (1001, "", None), (None, "x y", None), (1002, "word " * 30000, None)], table.schema))
    scored = quality.score_quality(more, model).withColumn("out", quality.held_out("doc_id", 5, 0)).collect()
    assert len(scored) == 404 and all(0 <= r.quality_score <= 1 for r in scored)
    held = [r for r in scored if r.out and r.quality is not None]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored if r.doc_id is not None)
    assert np.mean([r.quality_predicted == r.quality for r in held]) > 0.95
    empty = quality.fit_quality(table.limit(0).select("doc_id", "text"), table.limit(0).select("doc_id", "quality"))
    assert quality.score_quality(table.limit(1), empty).first().quality_score == pytest.approx(0.5)


def test_language(spark):
    dice = random.Random(5)
    alphabets = {"aa": "abcde", "bb": "efghij", "cc": "klmnoab", "dd": "äöüßxyz"}
    rows = [(i, " ".join("".join(dice.choice(alphabets[k]) for _ in range(6)) for _ in range(20)), k) for i, k in enumerate(sorted(alphabets) * 60)]
    odd = [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, "abcde " * 20000, None), (None, "abc", None)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict_languages(table, language.fit_languages(table)).collect()}
    assert len(got) == 245 and [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    nothing = language.predict_languages(table, language.fit_languages(table.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9):
        codes = language.codewords(n)
        assert len({tuple(c) for c in codes}) == n and all(abs(c.sum()) < n for c in codes.T)


# Personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    dice = random.Random(6)
    texts = [None, "", "a@b.c_d@e.f", "é +1 (555) 123-4567 x@y.zz 4111 1111 1111 1111, 10.0.0.1 256.1.1.1 1.2.3.4.5", "a@b", "@b.c", "1" * 30, "a." * 3000 + "@x.y", "x@y.z " * 700, "4111-1111-1111-1111-", "9 " * 9000]
    texts += ["".join(dice.choice(dice.choice(["ab@.", "0123456789. ", "+0123456789 ()-", "é@a.b-_"])) for _ in range(dice.randrange(60))) for _ in range(400)]
    table = docs(spark, *texts).withColumn("start", F.lit("clash"))
    rows = pii.find_spans(table, pii.fit_spans(table)).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        assert [(s.kind, s.start, s.end) for s in r.pii if s.base] == base_spans(text)


def test_more_spans_and_redaction(spark):
    texts = ["Please write to jane [at] example [dot] com today", "call (555) 123-4567 now", "mail a@b.com or a@c.org", "clean text, version 1.2.3 of 2024-01-02", "+1 (555) 123-4567, 4111 1111 1111 1111"]
    table = docs(spark, *(texts * 5))
    model = pii.fit_spans(table)
    found = pii.redact(pii.find_spans(table, model)).orderBy("doc_id").collect()
    assert [r.text for r in found[:5]] == ["Please write to [EMAIL] today", "call [PHONE] now", "mail [EMAIL] or [EMAIL]", texts[3], "[PHONE], [CARD]"]
    assert model.reliability["format"] > 0.5
    assert pii.fit_spans(docs(spark)).accepted == {k: [] for k in pii.KINDS}


def test_further_kinds_and_overlaps(spark):
    texts = [
        'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "account GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789 but 000-12-3456", "from Dr. Maria Weber, yes",
        "é\ufeff +1 (555) 123-4567 and (555) 123-4567\ufeff", "commit sha 04dbebab91ab85687d33eeaaf9ac699e1188f962", "plainwords-and-more-plain-words and nothing", "1234.5678.9012.3452 4111",
    ]
    table = docs(spark, *(texts * 6)).withColumn("pii", F.lit("clash"))
    found = pii.find_spans(pii.with_candidates(table), pii.fit_spans(table)).orderBy("doc_id").limit(len(texts)).collect()
    got = [[(s.kind, texts[i][s.start : s.end]) for s in r.pii if not s.base] for i, r in enumerate(found)]
    assert got[0] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")] and got[1] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert got[2] == [("national", "123-45-6789")] and got[3] == [("person", "Dr. Maria Weber")] and got[4] == [("phone", "(555) 123-4567")] and got[6] == []
    clean = pii.redact(pii.find_spans(table, pii.fit_spans(table))).orderBy("doc_id").limit(len(texts)).collect()
    assert clean[4].text == "é\ufeff [PHONE] and [PHONE]\ufeff" and clean[0].text == 'x token = "[SECRET]" y'


def test_redaction_of_many_spans(spark):
    dice = random.Random(4)
    text = "".join(dice.choice(["é@x.yz ", "a@b.c", " ", "w", "\U0001f600", "\ufeff", "+49 170 1234567;"]) for _ in range(2000))
    row = pii.redact(pii.find_spans(docs(spark, text), pii.fit_spans(docs(spark, text)))).first()
    out, at = "", 0
    for start, end, kind in sorted((s.start, s.end, s.kind) for s in row.pii):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    assert row.text == out + text[at:] and len(row.pii) > 300


def test_running_sums(spark):
    rows = spark.createDataFrame([([],), ([5],), (list(range(300)),)], "x array<bigint>")
    for r in rows.select("x", pii.running_sums(F.col("x")).alias("s")).collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]


# The pipeline


def test_pipeline(spark, tmp_path):
    dice = random.Random(7)
    rows = labelled(150)
    items = [prose(dice, 40), prose(dice, 30)]
    texts = [r[1] for r in rows]
    texts[31], texts[32] = prose(dice, 20) + " " + items[0] + " " + prose(dice, 20), texts[1]
    texts[34], texts[35] = "write to someone@example.com " + texts[34], None
    docs(spark, *texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], r[2], 0) for r in rows if r[0] not in (31, 32, 34, 35)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, str(tmp_path)).columns == read.columns, name
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = quality.fit_quality(read, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = {r.doc_id for r in quality.score_quality(read, model).filter("quality_predicted = 1").collect()}
    copies = components([texts[i] if i in good else None for i in range(150)])
    expected = {i for i in good if copies[i][1] == i} - {31}
    assert set(out) == expected and 31 in good and 1 in expected and 32 not in expected
    assert all(r.decodes for r in out.values())
    import public_tokenizers

    from backtide.llm import bpe

    coder = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, r in out.items():
        text = re.sub(PATTERNS[0][1], "[EMAIL]", texts[i] or "")
        ids = np.frombuffer(coder.encode(text), "<i4").tolist()
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
