from sparkloom.streaming.index import index_stream, read_index


def test_batches_add_up_and_do_not_repeat(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    source, folder, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(schema).parquet(source), folder, marks, {"strategy": "paragraph"}).awaitTermination()

    arrive([(1, "One two.\n\nTwo three.", "en", "s")])
    arrive([(2, "Three three.", "en", "s")])
    chunks, postings = read_index(spark, folder)
    assert sorted(r.chunk_id for r in chunks.collect()) == ["1#0", "1#1", "2#0"]
    assert {(r.chunk_id, r.term): r.tf for r in postings.where("term = 'three'").collect()} == {("1#1", "three"): 1, ("2#0", "three"): 2}
    arrive([(3, "", "en", "s")])
    assert read_index(spark, folder)[0].count() == 3
