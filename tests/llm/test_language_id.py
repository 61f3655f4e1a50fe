import math
import random

from pyspark.sql import functions as F

from tessella.llm import language_id, queries
from tessella.llm.common import id_remainder

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row["a"] >= 0.95 and 0 <= row["lo"] <= row["hi"] <= 1


def test_edges(spark):
    texts = {"en": "the cat and the dog were there with them", "de": "der Hund und die Katze sind nicht auf dem Dach", "fr": "le chat et le chien sont dans la maison avec nous", "es": "el gato y el perro no est\u00e1n en la casa con nosotros"}
    rows = [(i, f"{t} {t}", lang, "x") for k, (lang, t) in enumerate(texts.items()) for i in range(10 * k, 10 * k + 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    odd = spark.createDataFrame([(1, None, None, "a"), (2, "", "en", None), (3, "12 345 !?", None, None), (4, "\u00e9", None, None), (5, texts["de"].upper() * 5000, None, None), (5, texts["de"] * 2, None, None), (None, texts["es"], None, None)], SCHEMA)
    got = {(r["doc_id"], len(r["text"] or "")): r for r in language_id.identify(odd, model).collect()}
    assert len(got) == 7
    pred = {k: (r["lang_pred"], r["score"]) for k, r in got.items()}
    assert pred[1, 0] == pred[2, 0] == pred[3, 9] == ("und", 0.0)
    assert pred[4, 1][0] in texts
    assert {v[0] for k, v in pred.items() if k[0] == 5} == {"de"} and pred[None, len(texts["es"])][0] == "es"
    assert sorted(r["doc_id"] or 0 for r in language_id.accepted(odd, model).collect()) == [0, 4, 5, 5]
    assert language_id.accepted(odd, model).columns == odd.columns
    assert {r["score"] for r in language_id.accepted(odd, model).collect()} == {None}
    assert [r["score"] for r in language_id.accepted(docs.limit(3), model).collect()] == ["x"] * 3
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_without_or_with_one_language(spark):
    docs = spark.createDataFrame([(1, "hello there", None, None)], SCHEMA)
    assert language_id.identify(docs, language_id.train(docs)).first()["lang_pred"] == "und"
    one = language_id.train(spark.createDataFrame([(i, "bonjour tout le monde", "fr", None) for i in range(4)], SCHEMA))
    row = language_id.identify(docs, one).first()
    assert row["lang_pred"] == "fr" and row["score"] == 1.0


def test_training_reads_a_bounded_sample(spark):
    docs = spark.createDataFrame([(i, f"word{i} again", "en" if i % 2 else "fr", None) for i in range(400)], SCHEMA)
    a, b = (language_id.train(docs, per_language=50, iterations=3) for _ in range(2))
    assert (a.weights == b.weights).all()
    assert docs.where(id_remainder(F.col("doc_id"), 4) == 2).count() < 400


def test_the_machines_decide_what_is_accepted(spark, sf):
    """Long texts in no learned language go, though they have letters; those of the table stay; nothing goes without a model."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(table.where(id_remainder(F.col("doc_id"), 4) != 2))
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    junk = [" ".join(word("bcdfghjklmnpqrstvwxz") for _ in range(200)), " ".join(word("qxzjkvw") for _ in range(200)), "x" * 600]
    odd = spark.createDataFrame([(-1 - k, t, "en", None, None) for k, t in enumerate(junk)] + [(-9, "qxz", "en", None, None)], table.schema)
    kept = {r["doc_id"] for r in language_id.accepted(table.unionByName(odd), model).collect()}
    assert not kept & {-1, -2, -3} and -9 in kept
    assert len(kept) > 0.999 * table.count()
    assert {r["doc_id"] for r in language_id.accepted(odd, language_id.Model()).collect()} == {-1, -2, -3, -9}


def test_predictions_are_those_of_plain_loops(spark, sf):
    """The same weights applied trigram by trigram, votes counted by hand."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(table.where(id_remainder(F.col("doc_id"), 4) != 2))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(table, model).collect()}
    for r in table.limit(60).collect():
        data = (" " + r["text"].lower() + " ").encode()
        data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in data)
        grams = [data[k : k + 3] for k in range(len(data) - 2)]
        seen = [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> 18 for g in grams if g != b"   "]
        margin = {p: sum(float(w[c]) for c in seen) * 1000 / len(seen) + o for p, w, o in zip(model.pairs, model.weights, model.offsets, strict=True)}

        def winner(names, margin=margin):
            votes = {n: 0 for n in names}
            for (a, b), m in margin.items():
                if a in votes and b in votes:
                    votes[a if m >= 0 else b] += 1
            best = max(names, key=lambda n: votes[n])
            return best, [m if a == best else -m for (a, b), m in margin.items() if best in (a, b) and a in votes and b in votes]

        family, sure = winner(list(model.families))
        lang, within = winner(model.families[family])
        assert got[r["doc_id"]][0] == lang
        assert abs(got[r["doc_id"]][1] - 1 / (1 + math.exp(-2 * min(sure + within)))) < 1e-6
