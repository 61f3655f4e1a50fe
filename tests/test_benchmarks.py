"""Each benchmark's rules against plain loops, with scores that tie often."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.operators import benchmarks, runner


def score(prompt, choice):
    return F.conv(F.substring(F.md5(F.concat(prompt, F.lit("|"), choice)), 1, 1), 16, 10).cast("int") % 3


def plain(prompt, choice):
    return int(hashlib.md5(f"{prompt}|{choice}".encode()).hexdigest()[0], 16) % 3


def first(scores):
    return scores.index(max(scores))


def accuracy(found, by):
    return {tuple(r[b] for b in by): (r["n"], r["n_correct"]) for r in runner.accuracy(found, by).collect()}


def counted(results):
    out = {}
    for key, right in results:
        n, ok = out.get(key, (0, 0))
        out[key] = (n + 1, ok + bool(right))
    return out


def ran(made, scorer=score):
    rows, run = made
    return runner.answered(rows, run, scorer)


@pytest.mark.parametrize(("scores", "gold", "want"), [([1, 3, 3], 2, (1, 2, 2, 1)), ([3, 3, 1], 0, (0, 1, 0, 1)), ([2, 1], 0, (0, 0, 0, 0)), ([1, 1], -1, (0, 1, 0, 0)), ([5], 0, (0, 0, 0, 0)), ([], 0, (None,) * 4)])
def test_ties(spark, scores, gold, want):
    row = spark.createDataFrame([(scores, gold)], "s array<int>, g int")
    got = row.select(*[runner.chosen(F.col("s"), F.col("g"), t).alias(t) for t in ("first", "last", "gold", "strict")]).first()
    assert tuple(got) == want
    with pytest.raises(ValueError, match="first, last"):
        runner.chosen(F.col("s"), F.col("g"), "other")


def test_belief_stories(spark):
    rows = [(str(k), c, f"story {k} {c}", ("forward", "backward")[k % 2]) for k in range(40) for c in ("text_tb", "text_fb") if (k, c) not in ((3, "text_tb"), (4, "text_fb"))]
    got = accuracy(ran(benchmarks.true_and_false_belief(spark.createDataFrame(rows, "id string, condition string, text string, type string"), "S: {{story}}")), ["type"])
    results = []
    for k in range(40):
        if k not in (3, 4):
            for c in ("text_tb", "text_fb"):
                yes, no = (plain(f"S: story {k} {c}", x) for x in ("Yes", "No"))
                results.append(((("forward", "backward")[k % 2],), yes > no if c == "text_tb" else no > yes))
    assert got == counted(results)


def test_mirrored_alternatives(spark):
    rows = [(k, f"It rained {k}.", ("cause", "effect")[k % 2], f"a{k}", f"b{k}", k % 3 % 2, k % 5 == 0) for k in range(60)]
    got = accuracy(ran(benchmarks.mirrored_alternatives(spark.createDataFrame(rows, "id int, premise string, question string, choice1 string, choice2 string, label int, mirrored boolean"))), ["mirrored"])
    results = []
    for k, premise, question, a, b, label, mirrored in rows:
        one, two = (plain("", f"{c} so {premise[:-1]}" if question == "cause" else f"{premise[:-1]} so {c}") for c in (a, b))
        results.append(((mirrored,), (0 if one > two else 1) == label))
    assert got == counted(results)


@pytest.mark.parametrize("gold_wins", [False, True])
def test_strategy(spark, gold_wins):
    rows = [(k, f"s{k}", [f"C{j}" for j in range(2 + k % 3)], ["C1 ", "b)", "1", "c0", "A", "none", "7"][k % 7]) for k in range(70)] + [(90, "", ["x"], "x"), (91, "s", [], "x"), (92, "s", ["x"], ""), (93, None, ["x"], "x")]
    got = {r["id"]: r["correct"] for r in benchmarks.strategy(spark.createDataFrame(rows, "id int, scenario string, choices array<string>, target string"), "{{scenario}}", score, gold_wins).collect()}
    want = {}
    for k, s, choices, target in rows[:70]:
        t = target.lower().strip().rstrip(")")
        scores = [plain(s, f" {chr(65 + i)}) {c}") for i, c in enumerate(choices)]
        golds = [c.lower().strip() == t or chr(97 + i) == t or (t.isdigit() and int(t) == i) for i, c in enumerate(choices)]
        best = first(scores)
        if gold_wins and True in golds and scores[golds.index(True)] == max(scores):
            best = golds.index(True)
        want[k] = golds[best]
    assert got == want


def test_diplomacy_and_formality(spark):
    rows = [(k, f"m{k}", ["true", "False", "Truthful ", "deceptive", "maybe"][k % 5]) for k in range(50)]
    got = accuracy(ran(benchmarks.diplomacy(spark.createDataFrame(rows, "id int, message string, label string"), "M {{message}}")), ["label"])
    results = []
    for k, m, label in rows:
        named = {"t": "truthful", "f": "deceptive", "d": "deceptive"}.get(label.lower()[0])
        if named:
            t, d = (plain(f"M {m}", x) for x in ("truthful", "deceptive"))
            results.append(((named,), ("truthful" if t > d else "deceptive") == named))
    assert got == counted(results)
    pairs = [(str(k), ("x", "y")[k % 2], f"Dear {k} " * 200, f"hi {k}") for k in range(30)]
    found = ran(benchmarks.formality(spark.createDataFrame(pairs, "id string, category string, formal string, informal string"), "T {{text}}")).collect()
    want = {}
    for k, category, formal, informal in pairs:
        for side, text, right in (("formal", formal[:512], 0), ("informal", informal, 1)):
            s = [plain(f"T {text}", x) for x in "AB"]
            want[f"{k}/{side}"] = (category, s[right] - s[1 - right], s[right] > s[1 - right])
    assert {r["item"]: (r["category"], r["margin"], r["correct"]) for r in found} == want


def test_steps_and_spatial(spark):
    labels = ["left", "right", "above", "below", "overlap"]
    rows = [(k, f"story {k}" if k != 5 else "", "q", [" Left", "RIGHT", "overlap", "nowhere"][k % 4], k % 14 if k % 9 else None) for k in range(60)]
    got = {r["id"]: (r["k"], r["correct"]) for r in ran(benchmarks.steps(spark.createDataFrame(rows, "id int, story string, question string, label string, k int"), "{{story}} {{question}}", labels)).collect()}
    want = {}
    for i, story, q, label, k in rows:
        if story and (k or 0 if k is not None else 1) <= 10:
            want[i] = (k, labels[first([plain(f"{story} {q}", chr(65 + j)) for j in range(5)])] == label.strip().lower())
    assert got == want
    kinds = ["FR", "yes/no", "Choose Object", None]
    rows = [(k, f"s{k}", "q", ["Yes", "left", "B ", "no"][k % 4], ["a", "B", "left"] if k % 3 == 0 else None, kinds[k % 4]) for k in range(48)]
    got = {r["id"]: (r["kind"], r["correct"]) for r in ran(benchmarks.spatial(spark.createDataFrame(rows, "id int, story string, question string, answer string, choices array<string>, kind string"), "{{story}} {{question}}", labels)).collect()}
    want = {}
    for k, story, q, answer, choices, kind in rows:
        kind = {"FR": "FR", "yes/no": "YN", "Choose Object": "CO", None: "unknown"}[kind]
        options = choices or (["Yes", "No"] if kind == "YN" else labels)
        want[k] = (kind, options[first([plain(f"{story} {q}", c) for c in options])].lower() == answer.strip().lower())
    assert got == want


def test_legal_lettered_and_financial(spark):
    rows = [(k, f"t{k % 3}", f"text {k}", [" yes", "no", "maybe"][(k * k) % (2 + k % 3 % 2)] if k < 60 else "late") for k in range(75)]
    got = {r["id"]: r["correct"] for r in ran(benchmarks.legal(spark.createDataFrame(rows, "id int, task string, text string, answer string"), "{{text}}", per_task=20)).collect()}
    want = {}
    for task in ("t0", "t1", "t2"):
        some = [r for r in rows if r[1] == task][:20]
        answers = sorted({r[3].strip() for r in some})
        for k, _, text, answer in some:
            want[k] = answers[first([plain(text, a) for a in answers])] == answer.strip()
    assert got == want and len(want) == 60
    rows = [(k, f"q{k}", ["a", "b", "c"][: 2 + k % 2], k % 2, ("bio", "geo")[k % 2], [None, "", "png"][k % 3]) for k in range(30)]
    frame = spark.createDataFrame(rows, "id int, question string, choices array<string>, answer int, subject string, image string")
    got = accuracy(ran(benchmarks.lettered(frame, "{{question}}", "subject", "image")), ["subject"])
    assert got == counted([((s,), first([plain(q, chr(65 + j)) for j in range(len(c))]) == a) for _, q, c, a, s, i in rows if not i])
    rows = [(k, f"q{k}", f"{k}%") for k in range(300)]
    found = benchmarks.financial(spark.createDataFrame(rows, "id int, question string, answer string"), lambda q: F.concat(F.lit("it is "), F.when(q.endswith("7"), "0").otherwise(F.substring(q, 2, 9)))).collect()
    assert len(found) == 200 and all(r["correct"] == (r["id"] % 10 != 7) for r in found)
