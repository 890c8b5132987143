import random

import pytest
from pyspark.sql import functions as F

from tonescope.operators import containment, runlogs


def brute(needles, haystacks):
    return {(i, j) for i, a in needles for j, b in haystacks if i and j and a and b and a in b}


def rows(spark, texts):
    return spark.createDataFrame(texts, "id string, text string").repartition(3)


@pytest.mark.parametrize("gram,window", containment.TIERS)
def test_windows_of_a_part_are_windows_of_the_whole(gram, window):
    draw = random.Random(gram * 100 + window)
    for _ in range(100):
        whole = "".join(draw.choice("abcé漢🎉 ") for _ in range(draw.randrange(gram + window - 1, 200)))
        n = draw.randrange(gram + window - 1, len(whole) + 1)
        a = draw.randrange(len(whole) - n + 1)
        part = set(containment.windows(whole[a:a + n], gram, window).tolist())
        assert part and part <= set(containment.windows(whole, gram, window).tolist())
    assert not len(containment.windows("x" * (gram + window - 2), gram, window))


def test_contained_equals_all_pairs(spark):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("abcd é漢") for _ in range(n))
    passage = text(60)                                    # in a third of all haystacks
    haystacks = [(f"h{i}", text(draw.randrange(0, 300)) + (passage if i % 3 == 0 else "") + text(40)) for i in range(60)]
    needles = [("passage", passage), ("cut", passage[5:50]), ("twin", passage), ("long", passage + text(300)),
               ("none", None), ("empty", ""), (None, passage), ("same", haystacks[7][1]), ("two", "ab"), ("one", "c"),
               ("two texts", passage[:33]), ("two texts", "nowhere to be found in any of the texts")]
    needles += [(f"n{i}", haystacks[draw.randrange(60)][1][draw.randrange(30):][:draw.randrange(1, 60)]) for i in range(80)]
    needles += [(f"x{i}", text(draw.randrange(3, 40))) for i in range(40)]
    haystacks += [("h1", passage * 300), ("null", None), ("void", ""), (None, passage), ("🎉", "🎉" * 40)]
    needles += [("party", "🎉" * 33)]
    got = {tuple(r) for r in containment.contained(rows(spark, needles), rows(spark, haystacks)).collect()}
    assert got == brute(needles, haystacks)


def test_many_and_few_wanted_prints(spark, monkeypatch):
    """Prints that go to all tasks and prints that are joined find the same; a task gives out only what is asked for."""
    haystacks = [(f"h{i}", f"the text number {i} holds Brand#{i % 7} and little else") for i in range(50)]
    needles = [(f"n{i}", f"Brand#{i}") for i in range(9)] + [("w", "the"), ("x", "the text"), ("no", "zzz")]
    got = [{tuple(r) for r in containment.contained(rows(spark, needles), rows(spark, haystacks)).collect()}]
    wanted = containment.prints(rows(spark, needles)).select("tier", "print").distinct()
    tiers = sorted({r.tier for r in wanted.collect()})
    few = containment.held_prints(rows(spark, haystacks), wanted, tiers)
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(containment, "HANDED", 0)
    many = containment.held_prints(rows(spark, haystacks), wanted, tiers)
    assert sorted(few.collect()) == sorted(many.collect())
    got.append({tuple(r) for r in containment.contained(rows(spark, needles), rows(spark, haystacks)).collect()})
    assert got[0] == got[1] == brute(needles, haystacks)


def test_nothing_is_contained_in_nothing(spark):
    none, some = rows(spark, [("a", None)]).where("false"), rows(spark, [("a", "text")])
    assert containment.contained(none, some).count() == containment.contained(some, none).count() == 0


def test_leaks_name_their_own_task(spark):
    public = rows(spark, [("t1", "find the share; the gold is 12.5 percent of all"), ("t2", "nothing here")]).toDF("task_id", "public_text")
    gold = rows(spark, [("t1", "12.5 percent"), ("t2", "the gold is"), ("t3", "absent")]).toDF("task_id", "gold_text")
    got = {tuple(r) for r in runlogs.leaks(public, gold).collect()}
    assert got == {("t1", "t1", True), ("t2", "t1", False)}


def test_candidates_stay_near_the_answers(spark):
    """Texts that share a common passage but not their whole text are no candidates of each other."""
    common = "a passage that every single text of the table holds, whatever else it says. "
    texts = rows(spark, [(f"d{i}", common + f"text number {i} says {i * 7919} things of its own") for i in range(200)])
    got = containment.contained(texts, texts)
    assert got.where(F.col("needle_id") != F.col("haystack_id")).count() == 0 and got.count() == 200
