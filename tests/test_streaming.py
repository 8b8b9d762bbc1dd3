"""Row-wise jobs on a stream give the rows that they give on a table."""

from __future__ import annotations

from flowbench.streaming import jobs


def test_violations_of_arriving_graphs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"nodes":[{"id":1}],"edges":[]}')
    (tmp_path / "in" / "b.json").write_text('{"nodes":[],"edges":[]}')
    stream = jobs.stream_violations(jobs.stream_documents(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bad").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.path.rsplit("/", 1)[1], r.code) for r in spark.table("bad").collect()] == [("a.json", "nodes_id")]
