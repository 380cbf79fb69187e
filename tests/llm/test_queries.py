"""The digests of the registered queries, on a small table with nulls, repeats and very long texts, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from backtide.llm import bpe, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, shard int"


def _texts():
    dice = random.Random(17)
    words = "the of a house river winter Straße école 日本 x1 quickly and or mail report number 12 7 don't ... !".split()
    texts = [" ".join(dice.choice(words) for _ in range(dice.randrange(3, 60))) for _ in range(20)]
    texts += [None, "", " \n\t ", "one", texts[0], texts[0], texts[1] + " more", "ab" * 4000, "word " * 3000]
    texts += ["write to a.b+c@mail.example.org or 10.0.0.255, 300.1.1.1", "card 4111 1111 1111 1111 and +49 (30) 123-456 78", "4111111111111112 +1 2 x@y x@y.z 1.2.3.4.5"]
    return texts


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at, texts = tmp_path_factory.mktemp("tables"), _texts()
    rows = [(100 + 3 * i, t, "en", "s", None, "clash", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at), {r[0]: r[1] for r in rows}


def _sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, table):
    at, texts = table
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: coder.encode_ordinary(t or "") for i, t in texts.items()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_byte_bpe(spark, at).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {i: (len(ids), _sha(" ".join(map(str, ids))), _sha(texts[i] or "")) for i, ids in want.items()}


def test_op2(spark, table):
    at, texts = table
    rows = {r.doc_id: r for r in queries.op2_byte_shards(spark, at).collect()}
    assert {i: (r.size, r.text_crc32, r.law, r.grown_shard) for i, r in rows.items()} == {
        i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()) if t is not None else r_crc(rows[i]), "bytes", None) for i, t in texts.items()
    }
    slots = defaultdict(list)
    for r in rows.values():
        slots[r.shard].append(r.slot)
    assert all(0 <= s < 40 and sorted(own) == list(range(len(own))) for s, own in slots.items())


def r_crc(row):
    """A null text has no bytes: the checksum of none."""
    return row.text_crc32 if row.text_crc32 in (0, None) else -1


def test_op3(spark, table):
    at, texts = table
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = {r.doc_id: r for r in queries.op3_spot_signatures(spark, at).collect()}
    same = defaultdict(set)
    for i, t in texts.items():
        own, gift = t or "", texts[after[i]] or ""
        cut = len(own) // 3
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(own), _sha(own[: len(own) - cut] + gift[:cut]))
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        same[own].add(rows[i].fingerprint)
    assert all(len(prints) == 1 for prints in same.values())


def test_op4(spark, table):
    at, texts = table
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for i in sorted(texts):
        ids = [*words.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_id_planes(spark, at).collect()} == want


def test_op7(spark, table):
    at, texts = table
    sets = {}
    for i, t in texts.items():
        words = [w.decode("utf-8") for w in (t or "").encode().lower().split()]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = {i: (len(sets[i]), top(i), top(i) == i) for i in texts}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_hamming_neardup(spark, at).collect()} == want


def _luhn(digits):
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def test_op10(spark, table):
    at, texts = table
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    got = {r.doc_id: r for r in queries.op10_weak_pii(spark, at).collect()}
    for i, t in texts.items():
        spans = [[f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t or "") if fits(m[0])] for kind, (pattern, fits) in kinds.items()]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(map(len, spans))
        listed = [s for kind in spans for s in kind]
        assert got[i].base_sha256 == _sha(",".join(listed)) and set(listed) <= set(filter(None, got[i].spans.split(",")))


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark question with some words in it, more than thirteen of them to be sure")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
