from tagweave.__main__ import main


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(f"file://{path}").collect())


def test_commands(spark, tmp_path, sf):
    (tmp_path / "cache.txt").write_text("1\tcats,dog,the\n2\tdogs,cat\n3\tcat\n")
    (tmp_path / "dict.txt").write_text("cats\tcat\t0\ncat\tcat\t0\ndog\tdog\t0\ndogs\tdog\t0\nthe\tthe\t1\n")
    at = f"file://{tmp_path}"
    main(["bigrams", f"{at}/cache.txt", f"{at}/out", "--dictionary", f"{at}/dict.txt"], spark)
    assert lines(spark, tmp_path / "out/unigram") == ["    2\tdog", "    3\tcat"]
    assert lines(spark, tmp_path / "out/bigram") == ["    2\tcat\tdog"]
    main(["reduce", f"{at}/out/bigram,{at}/out/bigram", f"{at}/sum"], spark)
    assert lines(spark, tmp_path / "sum") == ["    4\tcat\tdog"]
    main(["make-vocab", f"{at}/out/unigram", f"{at}/vocab", "--min-count", "2"], spark)
    assert lines(spark, tmp_path / "vocab") == ["cat"]
    (tmp_path / "t.csv").write_text("IsA,cat,dog\nIsA,cat,cow\nUsedFor,dog,cat\n")
    (tmp_path / "r.txt").write_text("# kept\nisa\n")
    main(["filter-triples", f"{at}/t.csv", f"{at}/kept", "--relations", f"{at}/r.txt", "--pairs", f"{at}/out/bigram"], spark)
    assert lines(spark, tmp_path / "kept") == ["IsA,cat,dog"]
    main(["query", sf, f"{at}/q", "--name", "a01_unigrams"], spark)
    assert spark.read.parquet(f"{at}/q").count() > 0
