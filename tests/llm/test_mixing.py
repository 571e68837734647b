import hashlib
from collections import defaultdict
from fractions import Fraction

from churnspark.llm.mixing import leaf_budgets, mix
from pyspark.sql import functions as F


def share(budget, children):
    """Water-filling: children (supply, weight); exact shares, not rounded."""
    out, open_ = {}, {c for c, (s, w) in children.items() if s and w}
    left = Fraction(budget)
    while open_:
        total = sum(children[c][1] for c in open_)
        full = {c for c in open_ if children[c][0] * total <= left * children[c][1]}
        if not full:
            return out | {c: left * children[c][1] / total for c in open_}
        for c in full:
            out[c] = Fraction(children[c][0])
            left -= children[c][0]
        open_ -= full
    return out


def brute_leaves(tokens, budget, weights, epochs):
    """Exact leaf budgets, level by level with the shares of the level above."""
    got = {(): Fraction(min(budget, epochs * sum(tokens.values())))}
    for depth, level in enumerate(("domain", "language", "source")):
        supply = defaultdict(int)
        for path, n in tokens.items():
            supply[path[: depth + 1]] += n * epochs
        nxt = {}
        for parent, b in got.items():
            kids = {p: (s, weights.get(level, {}).get(p[-1], 1)) for p, s in supply.items() if p[:-1] == parent}
            nxt |= {p: share(b, kids).get(p, Fraction(0)) for p in kids}
        got = nxt
    return got


def test_budgets_run_down_the_tree(spark):
    tokens = {("a", "en", "x"): 900, ("a", "en", "y"): 30, ("a", "de", "x"): 10, ("a", None, "z"): 400, ("b", "en", "x"): 500, ("b", "fr", "q"): 0, (None, None, None): 77}
    leaves = spark.createDataFrame([(*p, n) for p, n in tokens.items()], "domain string, language string, source string, tokens long")
    for budget, weights, epochs in ((1000, {}, 1), (1917, {}, 1), (1500, {"domain": {"a": 3}, "language": {"en": 2}, "source": {"y": 5}}, 2), (700, {"domain": {"b": 0}}, 1), (0, {}, 3), (9000, {"source": {"x": 7}}, 3)):
        got = {(r["domain"], r["language"], r["source"]): r["budget"] for r in leaf_budgets(leaves, min(budget, epochs * 1917), weights, epochs).collect()}
        want = brute_leaves(tokens, budget, weights, epochs)
        assert set(got) == set(want)
        for p, b in got.items():  # each level rounds by less than one token
            assert abs(b - want[p]) < 3 and b <= tokens[p] * epochs, (p, b, float(want[p]))


def brute_copies(rows, budgets, seed):
    """Copies of each row, from the leaves' budgets."""
    out = []
    for leaf, budget in budgets.items():
        mine = [(i, n) for i, n, p in rows if p == leaf]
        total = sum(n for _, n in mine)
        epochs, left = (budget // total, budget % total) if total else (0, 0)
        order = lambda i: (hashlib.md5(f"{seed}:{epochs}:{'' if i is None else i}".encode()).hexdigest()[:12], "" if i is None else str(i))
        for i, n in mine:
            upto = sum(m for j, m in mine if order(j) <= order(i))
            out.append((str(i), n, epochs + int((left > 0 or not total) and upto <= left)))
    return sorted(out)


def check(spark, docs, **how):
    docs = docs.withColumn("domain", F.substring("source", 1, 1))
    out = mix(docs, domain=F.col("domain"), **how)
    rows = [(r["doc_id"], r["tokens"], (r["domain"], r["lang"], r["source"])) for r in out.collect()]
    assert all(n == len((t or "").split()) for (_, n, _), t in zip(rows, [r["text"] for r in out.collect()], strict=True))
    tokens = defaultdict(int)
    for _, n, p in rows:
        tokens[p] += n
    total, budget, epochs = sum(tokens.values()), how.get("budget", 1.0), how.get("max_epochs", 1)
    wanted = int(budget * total) if isinstance(budget, float) else budget
    leaves = spark.createDataFrame([(*p, n) for p, n in tokens.items()], "domain string, language string, source string, tokens long")
    budgets = {(r["domain"], r["language"], r["source"]): r["budget"] for r in leaf_budgets(leaves, min(wanted, total * epochs), how.get("weights", {}), epochs).collect()}
    assert sorted((str(r["doc_id"]), r["tokens"], r["copies"]) for r in out.collect()) == brute_copies(rows, budgets, how.get("seed", 0))
    spent = sum(n * c for n, c in ((r["tokens"], r["copies"]) for r in out.collect()))
    assert spent <= min(wanted, total * epochs)


def test_prefixes_of_epochs(spark, edge_docs):
    check(spark, edge_docs, budget=0.5)
    check(spark, edge_docs, budget=0.9, max_epochs=3, seed=11, weights={"language": {"en": 1, "de": 8, "fr": 20}, "source": {"s1": 4}})
    check(spark, edge_docs, budget=40)


def test_everything_and_empty_table(spark, edge_docs, no_docs):
    out = mix(edge_docs, domain=F.lit("d")).collect()
    assert {r["copies"] for r in out} == {1} and len(out) == edge_docs.count()
    assert mix(no_docs, domain=F.lit("d")).count() == 0


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 9, "old", 4)], "doc_id long, text string, lang string, source string, mix_key int, domain string, supply int")
    r = mix(docs, domain=F.lit("new")).first()
    assert (r["mix_key"], r["domain"], r["supply"], r["tokens"], r["copies"]) == (9, "new", 4, 3, 1)
