"""Duplicates as families: counts, places and pairs against plain versions, and large files."""

import random
import time

import pytest

from srcgauge.operators import duplicates
from srcgauge.plans import analysis

DDL = "file_id bigint, filename string, code string"


def function(name: str, words: list[str]) -> str:
    return f"function {name}(a) {{\n" + "\n".join(f" {w}" for w in words) + "\n\n\n\n\n}\n"


def brute(bodies: list[tuple[str, list[str]]]) -> list[tuple]:
    """(i, j, percent) of all pairs above 4/5."""
    sets = [set(function(n, w).split()) for n, w in bodies]
    out = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            shared, union = len(a & sets[j]), len(a | sets[j])
            if 5 * shared > 4 * union:
                out.append((i, j, int(shared / union * 100 + 0.5)))
    return out


def corpus(seed: int) -> list[tuple[str, list[str]]]:
    """Functions around the limit: shared cores, own words, words of small pools, copies."""
    rng = random.Random(seed)
    bodies = []
    for _ in range(140):
        core = [f"c{j}" for j in range(rng.choice([8, 16, 30]))]
        if rng.random() < 0.4:
            core = core[: len(core) - rng.randint(0, 4)] + [f"d{rng.randint(0, 2)}"]
        own = [f"own{len(bodies)}_{j}" for j in range(rng.choice([0, 0, 1, 2, 3]))]
        pool = [f"p{rng.randint(0, 12)}" for _ in range(rng.choice([0, 1, 2, 4]))]
        bodies.append((rng.choice(["same", f"f{len(bodies)}"]), core + own + pool))
        if rng.random() < 0.2:
            bodies.append(bodies[rng.randrange(len(bodies))])
    return bodies


def frame(spark, *codes: str):
    return spark.createDataFrame([(i, f"{i}.js", c) for i, c in enumerate(codes)], DDL)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [1, 4096])
def test_pairs_counts_and_places(spark, monkeypatch, seed, block):
    monkeypatch.setattr(duplicates, "BLOCK_PAIRS", block)
    bodies = corpus(seed)
    df = frame(spark, "".join(function(n, w) for n, w in bodies))
    want = brute(bodies)
    assert len(want) > 500
    pairs = [(r.i, r.j, r.percent) for r in duplicates.duplicate_pairs(df).collect()]
    assert sorted(pairs) == want
    assert duplicates.duplicate_counts(df).first().duplicates == len(want)
    issues = sorted(analysis.lint_all(df).collect(), key=lambda r: r.issue_ord)
    assert [r.issue_ord for r in issues] == list(range(len(issues)))
    told = [r for r in issues if r.rule == "duplicate-logic"]
    assert issues[-len(want) :] == told
    assert [f"{p}%" in r.message for (_, _, p), r in zip(want, told)] == [True] * len(want)
    assert analysis.file_counts(df).first().issueCount == len(issues)


def test_families_hold_every_pair_once(spark):
    bodies = corpus(4)
    df = frame(spark, "".join(function(n, w) for n, w in bodies))
    found = []
    for g in duplicates.duplicate_families(df).collect():
        for x in g.a:
            for y in g.b:
                if x.ord < y.ord or (not g.within and x.ord != y.ord):
                    i, j = sorted((x.ord, y.ord))
                    found.append((i, j, 100 if x.sid == y.sid else g.percent))
    assert sorted(found) == brute(bodies)
    groups = duplicates.duplicate_groups(df).collect()
    found = []
    for g in groups:
        for x in g.a:
            found += [(*sorted((x.ord, y.ord)), g.percent) for y in g.b if not g.copies or x.ord < y.ord]
    assert sorted(found) == brute(bodies)


def test_short_functions_come_first_in_no_pair(spark):
    short = "function s(a) {\n w x y z\n}\n"
    long = "function s(a) {\n w x y z\n\n\n\n\n\n}\n"
    df = frame(spark, short + long + short + long, short + short, "", "x")
    pairs = [(r.file_id, r.i, r.j) for r in duplicates.duplicate_pairs(df).collect()]
    assert sorted(pairs) == [(0, 1, 2), (0, 1, 3)]
    counts = {r.file_id: r.duplicates for r in duplicates.duplicate_counts(df).collect()}
    assert counts == {0: 2, 1: 0, 2: 0, 3: 0}


def test_documents_of_a_file_with_many_pairs(spark, monkeypatch):
    bodies = [(f"f{i}", [f"w{j}" for j in range(20)]) for i in range(60)]
    df = frame(spark, "".join(function(n, w) for n, w in bodies), function("g", ["a"]))
    whole = {r.file_id: r for r in analysis.analyze(df).collect()}
    assert len(whole[0].linterIssues) == whole[0].issueCount == 60 * 59 // 2
    monkeypatch.setattr(analysis, "DOCUMENT_PAIRS", 100)
    parts = sorted((r for r in analysis.analyze(df).collect()), key=lambda r: (r.file_id, r.part))
    assert [r.part for r in parts if r.file_id == 1] == [0] and len(parts) > 10
    parts = [r for r in parts if r.file_id == 0]
    assert [r.part for r in parts] == list(range(len(parts)))
    assert sum((r.linterIssues for r in parts), []) == whole[0].linterIssues
    assert len(parts[0].functions) == 60 and all(r.functions == [] for r in parts[1:])
    assert all(r.summary == whole[0].summary for r in parts)


def test_five_thousand_renamed_copies_are_counted(spark):
    """Neither the count nor the rows' blocks hold a file's pairs."""
    words = [f"word{j} = call{j}(a{j})" for j in range(25)]
    n = 5000
    df = frame(spark, "".join(function(f"f{i}", words) for i in range(n)))
    analysis.file_counts(frame(spark, function("warm", words) * 2)).collect()
    start = time.perf_counter()
    assert analysis.file_counts(df).first().issueCount == n * (n - 1) // 2
    assert time.perf_counter() - start < 60
    some = frame(spark, "".join(function(f"f{i}", words) for i in range(1200)))
    assert analysis.lint_all(some).count() == 1200 * 1199 // 2


@pytest.mark.parametrize("pool", [None, 20_000, 400])
def test_functions_alike_below_the_limit(spark, pool):
    """Functions that share 70 % of their words, the rest their own or from a pool: no rows."""
    def timed(n: int) -> float:
        rng = random.Random(n)
        common = [f"common{j}" for j in range(63)]
        rest = (  # eighteen lines and the signature's words are the rest
            lambda i: [f"own{i}_{j}" for j in range(26)]
            if pool is None
            else [f"pool{j}" for j in rng.sample(range(pool), 26)]
        )
        code = "".join(function(f"f{i}", [" ".join(common), " ".join(rest(i)), "", ""]) for i in range(n))
        df = frame(spark, code)
        start = time.perf_counter()
        assert duplicates.duplicate_pairs(df).count() == 0
        return time.perf_counter() - start

    timed(50)
    seconds = timed(4000)
    print(pool, seconds)
    assert seconds < 60
