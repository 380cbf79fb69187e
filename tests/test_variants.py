"""Many policies in one search, against a search for each."""

import random

from pyspark.sql import functions as F

from backtide.plans import trace, variants

LINKS = "child string, tbn string, pk string, col string, parent string, latest string, value string, certain boolean, rule string, read_seq long, read_time string"


def graph(spark, seed, requests=25, n=120):
    dice = random.Random(seed)
    rows = [(f"r{dice.randrange(requests)}", dice.choice("ab"), str(dice.randrange(6)), "c", f"r{dice.randrange(requests)}", "x", "v", dice.random() < 0.8, "2", i, "t") for i in range(n)]
    return [r for r in rows if r[0] != r[4]], spark.createDataFrame([r for r in rows if r[0] != r[4]], LINKS)


def test_each_variant_equals_a_search_of_its_own(spark):
    rows, links = graph(spark, 3)
    root = spark.createDataFrame([("r0",)], "rid string")
    tables = spark.createDataFrame([("a", True), ("b", False)], "tbn string, block boolean")
    verdicts = {str(k): ["keep", "block", "gray"][k % 3] for k in range(6)}
    classified = spark.createDataFrame([(t, k, v) for t in "ab" for k, v in verdicts.items()], "tbn string, pk string, verdict string")
    names = list(variants.ABLATION)
    visited, shown = variants.trace_variants(links, root, *variants.ablation_masks(tables, classified), len(names))
    gold = spark.createDataFrame([("r0",), ("r3",), ("r7",), ("nowhere",)], "rid string")
    scored = {r.variant: r for r in variants.variant_scores(visited, shown, root, gold, names).collect()}
    for i, (name, (of_tables, of_blocked, of_gray)) in enumerate(variants.ABLATION.items()):
        if name not in ("full", "no_row_block", "table_block_only"):
            continue
        gray = lambda t, k: (of_tables and t == "a") or (of_blocked and verdicts[k] == "block") or (of_gray and verdicts[k] == "gray")  # noqa: B023, E731
        own = spark.createDataFrame([(t, k, bool(gray(t, k))) for t in "ab" for k in verdicts], "tbn string, pk string, gray boolean")
        alone, alone_links = trace.trace(links, root, policy=own)
        want = {r.rid for r in alone.collect()}
        assert {r.rid for r in visited.filter(F.col("reached0").bitwiseAND(F.lit(1 << i)) != 0).collect()} == want
        lines = alone_links.collect()
        predicted = {"r0"} | {x for r in lines if r.certain for x in (r.child, r.parent)}
        s = scored[name]
        assert (s.tp, s.fp, s.fn) == (len(predicted & {"r0", "r3", "r7"}), len(predicted - {"r0", "r3", "r7"}), 4 - len(predicted & {"r0", "r3", "r7"}))
        assert (s.links, s.uncertain_no_recurse, s.gray_no_recurse) == (len(lines), sum(not r.certain for r in lines), sum(bool(gray(r.tbn, r.pk)) and r.child != "r0" for r in lines))
        ledger = variants.suppression_ledger(alone_links, root).collect()
        assert sum(r.uncertain_no_recurse for r in ledger) == s.uncertain_no_recurse and sum(r.gray_no_recurse for r in ledger) == s.gray_no_recurse


def test_more_variants_than_bits(spark):
    _, links = graph(spark, 5)
    root = spark.createDataFrame([("r0",)], "rid string")
    n = 2 * variants.BITS + 3
    rows = spark.createDataFrame([(t, str(k)) for t in "ab" for k in range(6)], "tbn string, pk string")
    row_masks = rows.select("tbn", "pk", *variants.masks([F.pmod(F.xxhash64("tbn", "pk", F.lit(i)), F.lit(3)) == 0 for i in range(n)]))
    none = spark.createDataFrame([("z",)], "tbn string").select("tbn", *variants.masks([F.lit(False)] * n))
    visited, shown = variants.trace_variants(links, root, none, row_masks, n)
    scores = {r.variant: r.links for r in variants.variant_scores(visited, shown, root, root, [str(i) for i in range(n)]).collect()}
    for i in (61, n - 1):
        own = rows.withColumn("gray", F.pmod(F.xxhash64("tbn", "pk", F.lit(i)), F.lit(3)) == 0)
        assert scores[str(i)] == trace.trace(links, root, policy=own)[1].count()


def test_raw_against_pruned(spark):
    rows, links = graph(spark, 8)
    links = links.select("child", "tbn", "pk", "parent").distinct()
    root = spark.createDataFrame([("r0",)], "rid string")
    policy = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "tbn string, pk string")
    bulk = spark.createDataFrame([("r4",), ("r9",)], "rid string")
    sizes, suppressed, only_raw = variants.raw_against_pruned(links, root, policy, bulk)

    def search(gray):
        edges = {(r[0], r[1], r[2], r[4]) for r in rows}
        seen, todo, shown, dropped = set(), ["r0"], set(), set()
        while todo:
            child = todo.pop()
            if child in seen:
                continue
            seen.add(child)
            for e in edges:
                if e[0] == child:
                    if e[3] in ("r4", "r9"):
                        dropped.add(e)
                    else:
                        shown.add(e)
                        if child == "r0" or e[1:3] not in gray:
                            todo.append(e[3])
        return shown, dropped

    (raw, _), (pruned, dropped) = search(set()), search({("a", "1"), ("b", "2"), ("b", "3")})
    context = {e for e in pruned if e[0] != "r0" and e[1:3] in {("a", "1"), ("b", "2"), ("b", "3")}}
    ends = lambda shown: {"r0"} | {x for e in shown for x in (e[0], e[3])}
    s = sizes.first()
    assert (s.raw_requests, s.raw_links, s.pruned_requests, s.pruned_links) == (len(ends(raw)), len(raw), len(ends(pruned)), len(pruned))
    assert (s.context_only, s.bulk_suppressed) == (len(context), len(dropped)) and context and dropped
    assert {(r.child, r.tbn, r.pk, r.parent) for r in only_raw.collect()} == raw - pruned
    assert {tuple(r) for r in suppressed.collect()} == {(*e, "gray-no-recurse") for e in context} | {(*e, "bulk-writer") for e in dropped}
    some = variants.suppressed_examples(suppressed, 2).collect()
    assert sorted(map(tuple, some)) == sorted([(*e, why) for part, why in ((context, "gray-no-recurse"), (dropped, "bulk-writer")) for e in sorted(part)[:2]])


def test_the_scan_has_every_parameter():
    scan = variants.scan_parameters()
    assert len(scan) == 1 + sum(map(len, variants.ONE_AT_A_TIME.values())) + 50 and scan["q=0.85"].q == 0.85
    joint = scan["amplification_threshold=4.5,write_request_guard=0.35"]
    assert (joint.amplification_threshold, joint.write_request_guard, joint.q) == (4.5, 0.35, 0.9)
