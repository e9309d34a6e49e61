import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.operators import ael, prefix_tree, replay, spell
from logweave.plans.config import PARAMETERS
from logweave.plans.extract import MINERS, mine, register_miner, template_table
from tests import models


def frame(spark, lines, start=1, step=1):
    rows = [(start + i * step, None if t is None else " ".join(t)) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "LineID long, Content string")


def mined(spark, lines, miner, **options):
    out = mine(frame(spark, lines), miner, **options).select("LineID", "Template").collect()
    assert len(out) == len(lines)
    return [r["Template"] for r in sorted(out)]


def random_lines(seed, words, n, lengths=(1, 6), wild=0.0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return [
        [
            "<#*#>" if rnd.random() < wild else rnd.choice(vocabulary)
            for _ in range(rnd.randint(*lengths))
        ]
        for _ in range(n)
    ]


# seed, vocabulary, lines, parameters, share of literal wildcards, lines per block
TREE_CASES = [
    (1, 4, 120, dict(depth=4, children=100, sim_thr=0.4), 0.0, 10_000),
    (2, 8, 150, dict(depth=3, children=3, sim_thr=0.4), 0.0, 30),
    (3, 30, 150, dict(depth=4, children=5, sim_thr=0.2), 0.0, 30),
    (5, 8, 150, dict(depth=3, children=1, sim_thr=0.2), 0.0, 50),
    (6, 4, 150, dict(depth=4, children=3, sim_thr=0.2), 0.15, 50),
]


@pytest.mark.parametrize("seed,words,n,params,wild,block", TREE_CASES)
def test_drain_equals_sequential(spark, seed, words, n, params, wild, block):
    lines = random_lines(seed, words, n, wild=wild)
    assert mined(spark, lines, "Drain", block_lines=block, **params) == models.drain(lines, **params)


@pytest.mark.parametrize("seed,words,n,params,wild,block", TREE_CASES[1:])
def test_routes_level_by_level(spark, monkeypatch, seed, words, n, params, wild, block):
    monkeypatch.setattr(prefix_tree, "FEW_PATHS", 0)
    lines = random_lines(seed, words, n, wild=wild)
    assert mined(spark, lines, "Drain", block_lines=block, **params) == models.drain(lines, **params)


@pytest.mark.parametrize("seed,words,n,params,wild,block", TREE_CASES)
def test_jaccard_drain_equals_sequential(spark, seed, words, n, params, wild, block):
    lines = random_lines(seed, words, n, wild=wild)
    expected = models.jaccard_drain(lines, **params)
    assert mined(spark, lines, "JaccardDrain", block_lines=block, **params) == expected


def test_drain_threshold_is_strict(spark):
    # 2 of 5 against 0.4 is not enough, against 0.39 it is
    lines = ["a b c d e".split(), "a b x y z".split()]
    assert mined(spark, lines, "Drain", sim_thr=0.4) == ["a b c d e", "a b x y z"]
    assert mined(spark, lines, "Drain", sim_thr=0.39) == ["a b <#*#> <#*#> <#*#>"] * 2


@pytest.mark.parametrize("seed,words,n,thr,block", [(1, 4, 80, 0.5, 10_000), (2, 8, 100, 0.4, 25), (3, 30, 100, 0.2, 40)])
def test_spell_equals_sequential(spark, seed, words, n, thr, block):
    lines = random_lines(seed, words, n)
    assert mined(spark, lines, "Spell", sim_thr=thr, block_lines=block) == models.spell(lines, thr)


@pytest.mark.parametrize("miner", ["Drain", "JaccardDrain", "Spell"])
def test_one_hot_route_in_many_blocks(spark, miner):
    """Most lines take the same way through the tree, far more than one block holds."""
    rnd = random.Random(9)
    lines = [f"job {rnd.choice('ab')} took {rnd.randint(1, 50)} ms on node {rnd.randint(1, 9)}".split() for _ in range(400)]
    expected = {"Drain": models.drain, "JaccardDrain": models.jaccard_drain, "Spell": models.spell}[miner](lines)
    assert mined(spark, lines, miner, block_lines=20) == expected


@pytest.mark.parametrize("miner,model", [("Drain", models.drain), ("Spell", models.spell), ("JaccardDrain", models.jaccard_drain)])
def test_tree_of_many_levels(spark, monkeypatch, miner, model):
    """Sixteen blocks under nodes of two children; nodes drop changes that only matter with what came before."""
    monkeypatch.setattr(replay, "FAN_IN", 2)
    lines = [["go", "on", *t] for t in random_lines(11, 5, 160, (2, 5))]
    assert mined(spark, lines, miner, block_lines=10) == model(lines)


def test_states_not_changes_reach_the_blocks(spark):
    """Every block of a hot route is given one state of about the same size, however many blocks there are."""
    rnd = random.Random(3)
    lines = [f"job {rnd.choice('abc')} took {rnd.randint(1, 999)} ms on node {rnd.randint(1, 99)}" for _ in range(4000)]
    rows = spark.createDataFrame([("", 0, i, t) for i, t in enumerate(lines)], "route string, level int, LineID long, content string")
    sizes = {}
    for blocks in (4, 16):
        cut = rows.repartitionByRange(blocks, "LineID").sortWithinPartitions("LineID").withColumn("block", replay.F.spark_partition_id())
        first = replay.materialize(cut.mapInArrow(replay._first_pass(lambda level: spell.SpellMiner(0.5), True), replay._ROWS))
        states = replay._scan(first, lambda level: spell.SpellMiner(0.5), blocks, None).where("state is not null").toPandas()
        assert sorted(states.node) == list(range(blocks))
        sizes[blocks] = states.state.map(len).max()
    assert sizes[16] <= 1.2 * sizes[4]


def test_answers_are_remembered_by_shape():
    run = replay.Replay(spell.SpellMiner(0.5))
    for i in range(500):
        run.step(i, f"user {i} came from {i * 7}")
    assert len(run.known) <= 3 and run.vocabulary >= {"user", "came", "from"}
    # a token that comes twice is another shape than two different ones
    rules = prefix_tree.jaccard_rules(3)
    once = replay.Replay(prefix_tree.PrefixTreeMiner(rules, 0))
    for lines in (["a b c d e"] * 2 + ["a b c x y", "a b c x x", "a b c z w", "a b c z z"],):
        seen = [" ".join(once.step(i, t)[0].tokens) for i, t in enumerate(lines)]
        plain = replay.Replay(prefix_tree.PrefixTreeMiner(rules, 0))
        want = []
        for i, t in enumerate(lines):
            plain.known.clear()
            want.append(" ".join(plain.step(i, t)[0].tokens))
        assert seen == want


def test_free_text_meets_few_templates():
    """Where every line opens a group, the index keeps lines from meeting all of them."""
    lines = [" ".join(t) for t in random_lines(5, 3000, 2000, (8, 14))]
    run = replay.Replay(spell.SpellMiner(0.5))
    for i, line in enumerate(lines):
        run.step(i, line)
    templates = len({leader for group in run.miner.index.first.values() for leader in group})
    assert templates > 1500 and run.miner.index.met < 0.02 * 2 * len(lines) ** 2 / 2


def test_common_words_lead_to_no_templates():
    """Lines share their common words with all templates, and still meet almost none; what a template has alone is one entry."""
    rnd = random.Random(12)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(4000)]
    lines = [" ".join(rnd.choice(common if rnd.random() < 0.35 else rare) for _ in range(rnd.randint(20, 60))) for _ in range(1500)]
    run = replay.Replay(spell.SpellMiner(0.5))
    assert sum(run.step(i, line)[0].leader == i for i, line in enumerate(lines)) > 1400
    assert run.miner.index.met < len(lines) and len(run.miner.prefixes.after) < 5 * len(lines)


def test_places_that_templates_left_are_taken_back():
    index = spell._SharedTokens(lambda n: -(-n // 2))
    groups = [replay.Group(i, ["a", f"b{i}", "c"]) for i in range(3)]
    for group in groups:
        index.add(group)
    for i in range(3000):
        index.remove(groups[0])
        groups[0].tokens = ["a", f"x{i}", "a"]
        index.add(groups[0])
    assert len(index.groups) < 2010
    assert index.sharing(["a", "x2999"]) == [groups[0]] and index.sharing(["c", "a"]) == groups[1:]


def test_contents_meet_few_leaders():
    lines = random_lines(6, 400, 3000, (9, 9))
    run = replay.Replay(ael.LeaderMiner(0.4))
    for i, line in enumerate(lines):
        run.step(i, " ".join(line))
    assert run.miner.leaders > 2000 and run.miner.met < 0.01 * len(lines) ** 2 / 2


@pytest.mark.parametrize("seed,words,n,thr,merge,block", [
    (1, 4, 150, 2, 1.0, 10_000), (2, 8, 150, 5, 1.0, 10_000), (3, 4, 150, 2, 0.4, 40), (4, 8, 150, 3, 0.6, 40),
    (5, 30, 150, 2, 0.0, 10_000),
])
def test_ael_equals_sequential(spark, seed, words, n, thr, merge, block):
    lines = random_lines(seed, words, n, wild=0.05)
    got = mined(spark, lines, "AEL", cluster_thr=thr, merge_thr=merge, block_lines=block)
    assert got == models.ael(lines, thr, merge)


@pytest.mark.parametrize("seed,words,n,var_thr", [(1, 4, 150, 2), (2, 8, 200, 3), (3, 30, 200, 5), (4, 3, 50, 1)])
def test_brain_equals_sequential(spark, seed, words, n, var_thr):
    lines = random_lines(seed, words, n)
    assert mined(spark, lines, "Brain", var_thr=var_thr) == models.brain(lines, var_thr)


@pytest.mark.parametrize("miner", sorted(MINERS))
def test_blank_lines_have_no_template(spark, miner):
    lines = [["a", "b", "c"], None, ["a", "b", "d"], [""], None]
    got = mined(spark, lines, miner)
    assert got[1] is None and got[4] is None and all(got[i] is not None for i in (0, 2, 3))


LOGS = {"a b": random_lines(21, 5, 60), "a": random_lines(22, 5, 45), "z": random_lines(23, 40, 50), "empty": [None]}


@pytest.mark.parametrize("miner,options", [
    ("Drain", dict(depth=3, children=3)), ("JaccardDrain", {}), ("Spell", {}), ("Brain", {}), ("AEL", {}), ("AEL", dict(merge_thr=0.4)),
])
def test_several_logs_are_mined_apart_in_the_same_jobs(spark, miner, options):
    """Line numbers repeat between logs; every template and id is that of the log alone."""
    rows = [(name, i, None if t is None else " ".join(t)) for name, lines in LOGS.items() for i, t in enumerate(lines, 1)]
    together = mine(spark.createDataFrame(rows, "source_path string, LineID long, Content string"), miner, log="source_path", **options)
    got = {(r.source_path, r.LineID): r.Template for r in together.collect()}
    model = {"Drain": models.drain, "JaccardDrain": models.jaccard_drain, "Spell": models.spell, "Brain": models.brain, "AEL": models.ael}[miner]
    want = {}
    for name, lines in LOGS.items():
        full = [t for t in lines if t is not None]
        found = iter(model(full, **options))
        want.update({(name, i): None if t is None else next(found) for i, t in enumerate(lines, 1)})
    assert got == want
    ids = [tuple(r) for r in template_table(together, "source_path").collect()]
    for name in LOGS:
        own = sorted((i, t, n) for path, i, t, n in ids if path == name)
        counts = {}
        for (path, _), t in want.items():
            if path == name and t is not None:
                counts[t] = counts.get(t, 0) + 1
        assert own == [(i, t, n) for i, (t, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))]


def test_number_of_jobs_does_not_grow_with_the_logs(spark):
    context, jobs = spark.sparkContext, {}
    for n in (2, 12):
        rows = [(f"log{k}", i, f"job {i % 3} of {k} took {i * 7 % 11} ms") for k in range(n) for i in range(1, 9)]
        context.setJobGroup(f"logs-{n}", "")
        mine(spark.createDataFrame(rows, "source_path string, LineID long, Content string"), "Drain", log="source_path").collect()
        jobs[n] = len(context.statusTracker().getJobIdsForGroup(f"logs-{n}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[12] <= jobs[2] + 1


@pytest.mark.parametrize("miner", sorted(MINERS))
def test_no_lines(spark, miner):
    assert mined(spark, [], miner) == []


def test_other_columns_and_delimiters_survive(spark):
    rows = spark.createDataFrame([(1, "x", "k=1 a:b"), (2, "y", "k=2 a:b")], "LineID long, Level string, Content string")
    out = mine(rows, "AEL", [(r"\d", "<#N#>")], "=:").orderBy("LineID").collect()
    assert [r.asDict() for r in out] == [
        {"LineID": 1, "Level": "x", "Content": "k=1 a:b", "Template": "k= <#N#> a: b"},
        {"LineID": 2, "Level": "y", "Content": "k=2 a:b", "Template": "k= <#N#> a: b"},
    ]


def test_template_ids_break_ties_by_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate("b b a a c".split())] + [(9, None)], "LineID long, Template string")
    got = [tuple(r) for r in template_table(rows).orderBy("template_id").collect()]
    assert got == [(0, "a", 2), (1, "b", 2), (2, "c", 1)]


def test_a_miner_of_ones_own(spark):
    def first_words(df, words, log=None):
        return df.withColumn("Template", F.array_join(F.slice(F.split("content", " "), 1, words), " "))

    register_miner("FirstWords", first_words, {"words": (1, 1, 9)})
    try:
        assert mined(spark, [["a", "b"], ["c"]], "FirstWords") == ["a", "c"]
        assert mined(spark, [["a", "b", "c"], None], "FirstWords", words=2) == ["a b", None]
        with pytest.raises(ValueError):
            mined(spark, [["a"]], "FirstWords", words=10)
        for name, spec in (("FirstWords", {}), ("Drain", {}), ("Other", {"x": (5, 6, 7)})):
            with pytest.raises(ValueError):
                register_miner(name, first_words, spec)
    finally:
        del MINERS["FirstWords"], PARAMETERS["FirstWords"]


@pytest.mark.parametrize("params", [dict(depth=3, children=3, sim_thr=0.4), dict(depth=4, children=2, sim_thr=0.6)])
def test_drain_with_many_groups_in_a_leaf(spark, params):
    """Lines of several lengths in one leaf, and templates that change after their leaf became a matrix."""
    lines = random_lines(21, 60, 600, lengths=(1, 12), wild=0.03)
    lines += [[*line[:-1], "other"] for line in lines[::3]]
    for block in (10_000, 90):
        assert mined(spark, lines, "Drain", block_lines=block, **params) == models.drain(lines, **params)


def test_large_leaf_is_compared_at_once():
    rules = prefix_tree.drain_rules()
    miner = prefix_tree.PrefixTreeMiner(rules, rules.levels)
    rnd, scored = random.Random(4), []
    miner.rules = replace(rules, score=lambda *a: scored.append(a) or rules.score(*a))
    run = replay.Replay(miner)
    for i in range(300):
        run.step(i, " ".join(["20", "a", "b"] + [f"w{rnd.randrange(10**6)}" for _ in range(17)]))
    assert len(miner.root[1]) == 300 and len(scored) <= prefix_tree.MANY ** 2


def test_first_pass_holds_batches_as_columns():
    """Routes that end inside a batch, at its edge, and that span batches; the ends of the block keep their content."""
    names = ["a", "a", "b", "c", "c", "c", "c", "d", "e", "e"]
    rows = pa.table({
        "route": names, "level": pa.array([0] * 10, pa.int32()), "LineID": pa.array(range(10), pa.int64()),
        "content": [f"{n} {i}" for i, n in enumerate(names)], "block": pa.array([7] * 10, pa.int32()),
    })
    make = lambda level: ael.LeaderMiner(0.5)
    for size in (1, 2, 3, 4, 10):
        out = pa.Table.from_batches(replay._first_pass(make, True)(iter(rows.to_batches(size)))).to_pylist()
        assert [r["LineID"] for r in out] == list(range(10)) and [r["leader"] for r in out] == [0, 0, 2, 3, 3, 3, 3, 7, 8, 8]
        assert [r["content"] for r in out] == ["a 0", "a 1"] + [None] * 6 + ["e 8", "e 9"]
        assert [r["Template"] for r in out] == ["a 0", "a 0", "b 2", "c 3", "c 3", "c 3", "c 3", "d 7", "e 8", "e 8"]
    assert all(r["content"] is None for b in replay._first_pass(make, False)(iter(rows.to_batches(3))) for r in b.to_pylist())


def test_one_batch_out_for_many_routes():
    """Free text has a route for nearly every line."""
    rows = pa.table({
        "route": [f"r{i:04d}" for i in range(1000)], "level": pa.array([0] * 1000, pa.int32()), "LineID": pa.array(range(1000), pa.int64()),
        "content": ["x y"] * 1000, "block": pa.array([0] * 1000, pa.int32()),
    })
    assert len(list(replay._first_pass(lambda level: ael.LeaderMiner(0.5), True)(iter(rows.to_batches(500))))) == 2


def test_ael_merge_explodes_only_what_differs(spark):
    lines = [["a", "b", str(i), "c"] for i in range(50)] + [["x"]]
    rows = frame(spark, lines)
    out = ael._merge(rows.select(F.lit(1).alias("bin"), "LineID", F.col("Content").alias("content")).where("LineID <= 50"), ["bin"])
    assert out.collect() == [(1, "a b <#*#> c")]
    assert "min(token" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed,lengths,wild", [(31, (1, 14), 0.03), (32, (9, 9), 0.0), (33, (3, 30), 0.0)])
def test_indexed_leaf_finds_what_the_model_finds(monkeypatch, seed, lengths, wild):
    monkeypatch.setattr(prefix_tree, "RUN", 8)
    params = dict(depth=3, children=2, sim_thr=0.4)
    rules = prefix_tree.drain_rules(**params)
    lines = random_lines(seed, 40, 900, lengths, wild)
    lines += [[*line, "tail", "more"] for line in lines[::4]] + [line[:-1] + ["z"] for line in lines[::5]]
    run = replay.Replay(prefix_tree.PrefixTreeMiner(rules, 0))
    groups = [run.step(i, " ".join(line))[0] for i, line in enumerate(lines)]
    found = [" ".join(g.tokens) for g in groups]
    assert found == [t if len(line) >= 2 else " ".join(line) for t, line in zip(models.drain(lines, **params), lines)]


def test_templates_share_their_tokens():
    rules = prefix_tree.drain_rules(depth=3, sim_thr=0.6)
    run = replay.Replay(prefix_tree.PrefixTreeMiner(rules, 0))
    for i in range(60):
        run.step(i, f"first w{i % 7} w{i % 5} common w{i % 3} last{i % 2}")
    groups, nodes = [], [run.miner.root]
    for node in nodes:
        groups += node[1]
        nodes += node[0].values()
    held = [t for g in groups for t in g.tokens]
    assert len(groups) > 5 and len({id(t) for t in held}) == len(set(held))


def test_alike_lines_equal_all_pairs():
    from collections import Counter

    from logweave.operators.overlap import alike, keys_of

    for seed, words, lengths in [(1, 12, (1, 5)), (2, 60, (3, 20)), (3, 300, (10, 40))]:
        lines = [" ".join(t) for t in random_lines(seed, words, 120, lengths, wild=0.02)]
        least = spell.SpellMiner(0.5)._least
        counts = [Counter(x.split(" ")) for x in lines]
        want = [any(i != j and (a & b).total() >= max(least(a.total()), least(b.total())) for j, b in enumerate(counts)) for i, a in enumerate(counts)]
        assert alike(keys_of(lines), None, least)[0].tolist() == want
        one, two = keys_of(lines[:50]), keys_of(lines[50:])
        inside = [*alike(one, None, least)[0], *alike(two, None, least)[0]]
        assert [a or b for a, b in zip(inside, [x for side in alike(one, two, least) for x in side])] == want


FREE = [(1, 40, 150, (1, 8), 0.0), (2, 400, 300, (2, 12), 0.0), (3, 60, 200, (2, 9), 0.05)]


@pytest.mark.parametrize("seed,words,n,lengths,wild", FREE)
def test_free_text_equals_sequential(spark, monkeypatch, seed, words, n, lengths, wild):
    """Lines that are alike to no other one are not looked for; the templates are those of all lines one after the other."""
    monkeypatch.setattr(spell, "FREE_LINES", 1)
    monkeypatch.setattr(spell, "FREE_SHARE", 1.0)
    lines = random_lines(seed, words, n, lengths, wild)
    assert mined(spark, lines, "Spell") == models.spell(lines)


def test_lines_alone_are_not_indexed(monkeypatch):
    added = []
    monkeypatch.setattr(spell._SharedTokens, "add", lambda self, group, add=spell._SharedTokens.add: (added.append(group.leader), add(self, group)))
    lines = ["a b c d", "e f g h", "a b c x", "a b y c"]
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array(lines), pa.array([False, True, False, False])], ["LineID", "content", "alone"])
    out = pa.Table.from_batches(spell._one_pass(0.5)([batch])).sort_by("LineID")
    assert out.column("Template").to_pylist() == models.spell([x.split(" ") for x in lines]) and 1 not in added


@pytest.mark.parametrize("seed,words,lengths,wild,block", [(1, 60, (4, 12), 0.0, 10_000), (2, 25, (5, 9), 0.05, 60), (3, 300, (3, 30), 0.0, 90)])
def test_drain_of_free_text_equals_sequential(spark, monkeypatch, seed, words, lengths, wild, block):
    """Lines that are alike to no other one of their leaf are not kept for later ones; templates are those of all lines one after the other."""
    monkeypatch.setattr(prefix_tree, "LARGE", 1)
    monkeypatch.setattr(prefix_tree, "FREE_SHARE", 1.0)
    lines = random_lines(seed, words, 250, lengths, wild)
    params = dict(depth=4, children=3, sim_thr=0.4)
    assert mined(spark, lines, "Drain", block_lines=block, **params) == models.drain(lines, **params)


def test_lines_alone_are_not_kept_in_a_leaf():
    rules = prefix_tree.drain_rules()
    run = replay.Replay(prefix_tree.PrefixTreeMiner(rules, rules.levels, flagged=True))
    lines = ["+a b c d", "-e f g h", "-e f x h", "+i j k l"]
    steps = [run.step(i, x) for i, x in enumerate(lines)]
    assert [c for _, c in steps] == [False, True, True, False] and len(run.miner.root[1]) == 1
    assert [" ".join(g.tokens) for g, _ in steps] == ["a b c d", "e f <#*#> h", "e f <#*#> h", "i j k l"]
