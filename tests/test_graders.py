"""grader_results against a version in plain Python, whole texts."""

import re

from tessella.plans.evaluation import grader_results


def last(pattern, text):
    return ([m.group(0) for m in re.finditer(pattern, text)] or [None])[-1]


def place(text):
    named = re.findall(r"(?i)(?:is\s+(?:now\s+)?(?:in|at|located\s+at))\s+(.+?)(?:\.|$)", text)
    facility = last(r"(?i)(?:Station|Room|Cabinet|Ward|Shelf|Rack|Bay|Dock|Depot|Zone|Area)\s+\w+", text)
    return (named[-1] if named else facility or text.strip()[:100]).strip().lower()


def money(text):
    found = last(r"-?\d+\.?\d*%?", text.replace(",", ""))
    return None if found is None else float(found.rstrip("%"))


def brute(a, r):
    if r is None:
        return [False] * 4 + [a.strip() != ""] + [False] * 2
    same = a.strip().lower() == r.strip().lower()
    na, nr = (last(r"-?\d+\.?\d*(?:[eE][+-]?\d+)?", x) for x in (a, r))
    auto = na is not None and nr is not None and abs(float(nr) - float(na)) < 0.01 * max(abs(float(nr)), 1.0)
    w = last(r"-?\d+(?:\.\d+)?", r)
    near = w is not None and any(abs(float(x) - float(w)) <= max(1e-3, 1e-3 * abs(float(w))) for x in re.findall(r"-?\d+(?:\.\d+)?", a))
    pa, pr = place(a), place(r)
    tail = " ".join(r.split()[-5:]).lower()
    ma, mr = money(a), money(r)
    fin = same if ma is None or mr is None else abs(ma) < 0.01 if mr == 0 else abs(ma - mr) < 0.01 * max(abs(mr), 1e-8)
    return [auto, pr in pa or pa in pr, near, tail != "" and tail in a.lower(), a.strip() != "", fin, same]


def test_grader_results_see_whole_texts(spark, tmp_path):
    pad = "some plain words that say nothing at all " * 40
    texts = [
        f"{pad}the total was 41.5 {pad}", f"{pad}sum 41.5 {pad}", f"{pad}the box is in Room 7. {pad}", f"{pad}it is now at Room 7. {pad}",
        f"{pad}then the red fox went home {pad}", "the red fox went home", "The Red Fox Went Home", f"{pad}1,200 and 3 {pad}", "about 1200", f"{pad}12 % {pad}", "no number", "yes", " YES", "",
        "the key is in the box\n", "the box", "\n\t \u3000", "\xa0yes\n", "it is at the dock\r\n", "is in\nRoom 9\nor so", "at a desk\u2028it is at Bay 2\n\n",
    ]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["auto_number", "auto_location", "numeric", "location", "length_style", "financial", "label"]
    got = {r["doc_id"]: [r[n] for n in names] for r in grader_results(spark, str(tmp_path)).collect()}
    want = {k: brute(t, texts[k + 1] if k + 1 < len(texts) else None) for k, t in enumerate(texts)}
    assert got == want
    assert got[14][1] and not got[16][4] and got[15][4]
    assert got[0][0] and got[0][2] and got[2][1] and got[4][3]
