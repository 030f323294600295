"""Stream encoding, and the registry that grows batch by batch."""

from glyphmill.functions.lexicon import Lexicon
from glyphmill.streaming import encode as streams
from glyphmill.streaming.encode import classified, growing_registry, stored_registry


def test_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT_AFTER", 2)
    lex = Lexicon()
    texts = [(1, "kafka broker xyzzyq"), (2, "a suspicious payment, plughhq"), (3, "nothing xyzzyq")]
    schema = "doc_id bigint, text string"
    for k, row in enumerate(texts):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = classified(stream(), lex).select("doc_id", "domain").writeStream.format("memory").queryName("said").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT * FROM said").collect()} == {(1, "DevOps"), (2, "Finance"), (3, "general")}
    query = growing_registry(stream(), lex, str(tmp_path / "registry"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert (tmp_path / "registry" / "upto-2").exists()
    words = stored_registry(spark, str(tmp_path / "registry"), 3)
    assert sorted(map(tuple, stored_registry(spark, str(tmp_path / "registry"), 2).collect()), key=str) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "registry" / "upto-2")).collect()), key=str)
    rows = words.collect()
    assert {r.word for r in rows} >= {"xyzzyq", "plughhq"} and len({r.word for r in rows}) == len(rows)
    ids = [r.id for r in rows if r.id is not None]
    assert len(set(ids)) == len(ids)
