"""Row numbers are the same for every scan, whatever its splits."""

from touchline.llm import exact_dedup
from touchline.llm.common import ROW, numbered


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    path = f"{tmp_path}/a b%20é"
    spark.range(300).selectExpr("id AS doc_id", "concat('text ', id % 50) AS text", "1 AS _numbered_at").repartition(6).write.parquet(path)
    seen, kept = [], []
    for least in (1, 40):
        spark.conf.set("spark.sql.files.openCostInBytes", "4096")
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"]: r[ROW] for r in numbered(docs.select("doc_id", "text")).collect()})
        kept.append(sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()))
    for name in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(name)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 300
    assert kept == [list(range(50))] * 2


def test_rows_made_of_one_row_differ(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/x")
    twice = spark.read.parquet(f"{tmp_path}/x").selectExpr("explode(array(id, id)) AS doc_id")
    assert len({r[ROW] for r in numbered(twice).collect()}) == 20
