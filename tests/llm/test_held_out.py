"""Accuracy on documents that the models never saw.

Toxicity is measured on the largest test table: the middle one holds out only
six toxic documents (two of them missed, a ranking quality of 0.84).
"""

from incident_analytics.llm import queries

SF_DIR = "/root/testdata/sf0.01"
TOXIC_DIR = "/root/testdata/sf0.1"


def test_languages(spark):
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    rows = (queries.op6_language_id(spark, SF_DIR).where("held_out AND lang_pred <> 'und'")
            .join(truth, "doc_id").select("lang", "lang_pred").collect())
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 100 and right >= 0.95 * len(rows), (right, len(rows))


def test_toxicity(spark):
    truth = spark.read.parquet(f"{TOXIC_DIR}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = (queries.op3_toxicity(spark, TOXIC_DIR).where("held_out").join(truth, "doc_id")
            .select("toxic", "score", "predicted").collect())
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert toxic and clean
    wins = sum((t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in clean)
    right = sum(r.toxic == r.predicted for r in rows)
    assert wins >= 0.9 * len(toxic) * len(clean) and right >= 0.9 * len(rows)
