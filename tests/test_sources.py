import gzip

import pytest
from pyspark.sql import functions as F

from kernloom.operators import library, regions
from kernloom.sources import readers

GTF = """#!genome-build x
chr1\tsrc\tgene\t100\t200\t.\t+\t.\tgene_id "ENSG1.5"; gene_type "protein_coding"; gene_name "ABC-1";

chr1\tsrc\texon\t100\t150\t.\t+\t.\tgene_id "ENSG1.5"; gene_type "protein_coding"; gene_name "ABC-1";
chr2\tsrc\tgene\t10\t90\t.\t-\t.\tgene_id "ENSG00000186092.6"; gene_type "lncRNA";
"""


def test_gtf(spark, tmp_path):
    with gzip.open(tmp_path / "a.gtf.gz", "wt") as f:
        f.write(GTF)
    rows = readers.read_gtf(spark, str(tmp_path / "a.gtf.gz")).orderBy("chr", "feature").collect()
    assert [r["gene_name"] for r in rows] == ["ABC-1", "ABC-1", "ENSG00000186092"]
    assert readers.read_gtf(spark, str(tmp_path / "a.gtf.gz"), True).count() == 1


def test_gmt(spark, tmp_path):
    (tmp_path / "x.gmt").write_text("S1\thttp://u\tA\tB\nS2\tu\tC\n\n")
    got = [tuple(r) for r in readers.read_gmt(spark, str(tmp_path / "x.gmt")).orderBy("group", "gene").collect()]
    assert got == [("S1", "A"), ("S1", "B"), ("S2", "C")]


def test_results_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(0.1, "g", 1.0)], "alpha double, group string, kernel_weight double")
    for k in ("rna_1", "atac_1"):
        readers.write_results(frame, str(tmp_path / "r"), k)
    assert readers.read_results(spark, str(tmp_path / "r")).count() == 2
    assert [r["key"] for r in readers.read_results(spark, str(tmp_path / "r"), "^rna").collect()] == ["rna_1"]


def test_matrices(spark, tmp_path):
    (tmp_path / "m.csv").write_text("cell_id,feature,value\n1,a,2.5\n")
    assert tuple(readers.read_matrix(spark, str(tmp_path / "m.csv")).first()) == (1, "a", 2.5)
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 5\n2 2 6\n")
    got = sorted(tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect())
    assert got == [(0, 0, 5.0), (1, 1, 6.0)]


def test_organisms_and_terms(spark):
    assert library.check_organism("Human") == "human"
    with pytest.raises(ValueError):
        library.check_organism("dog")
    groups = spark.createDataFrame([("l", "Mouse T cell", "A"), ("l", "T cell", "A"), ("l", "x", "A")], "library string, group string, gene string")
    # an empty name of the other organism drops nothing
    assert library.check_groups(groups, "t cell", 5, "").count() == 3
    assert library.find_candidates(groups, "yeast").first()["n_groups"] == 3
    assert [r["group"] for r in library.check_groups(groups, "", False, "mouse").where("key_terms_in").orderBy("group").collect()] == ["T cell", "x"]


def test_regions(spark):
    anno = spark.createDataFrame([("chr1", 100, 200, "+", "A"), ("chr1", 100, 200, "+", "B"), ("chr1", 900, 1000, "-", "C"), ("chr3", 1, 2, "+", None)], "chr string, start long, end long, strand string, gene_name string")
    sets = spark.createDataFrame([("s", "A"), ("s", "B"), ("t", "C"), ("u", "Z"), ("u", None)], "group string, gene string")
    feats = spark.createDataFrame([("chr1-90-95",), ("chr1-1005-1200",), ("chr2-1-5000",)], "feature string")
    out = sorted((r[0], r[1] or "") for r in regions.region_groupings(anno, sets, feats, 10, 10).collect())
    assert out == [("s", "chr1-90-95"), ("t", "chr1-1005-1200"), ("u", "")]
    twice = regions.region_groupings(anno, sets, feats, 10, 10, distinct=False)
    assert twice.where("group = 's'").count() == 2
    bad = anno.withColumn("strand", F.lit("."))
    with pytest.raises(Exception, match="strand"):
        regions.promoters(bad).collect()


def test_intervals_of_any_length_meet_once(spark):
    import random

    from kernloom.operators import regions

    rng = random.Random(7)
    wide = lambda: rng.choice([1, 40, 999, 1000, 1001, 9000, 70_000, 10**6, 10**8, 10**12])

    def some(n):
        out = []
        for i in range(n):
            start = rng.choice([rng.randrange(-5000, 5000), rng.randrange(-(10**8), 10**8)])
            out.append((str(i), f"chr{i % 2}", start, start + rng.randrange(wide())))
        return [*out, (str(n), "chr0", 5, 4), (str(n + 1), "chr0", None, 4), (str(n + 2), None, 1, 4)]

    a, b = some(150), some(120)
    left = spark.createDataFrame(a, "feature string, chr string, start long, end long")
    right = spark.createDataFrame(b, "gene_name string, chr string, start long, end long")
    want = sorted((x[0], y[0]) for x in a for y in b if None not in (*x, *y) and x[2] <= x[3] and y[2] <= y[3] and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    for width in (10, 1000, 100_000):
        assert sorted(map(tuple, regions.overlap_join(left, right, width).collect())) == want
    long = left.where("feature = '0'").withColumns({"start": F.lit(3), "end": F.lit(100_000_003)})
    assert regions.overlap_join(long, right.limit(0)).count() == 0


def test_size_line_and_coding_genes(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%\n" + "% c\n" * 2000 + "2 2 2\n2 2 2\n1 1 5\n")
    for most in ("128m", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        got = sorted(tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect())
        assert got == [(0, 0, 5.0), (1, 1, 2.0)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "empty.mtx").write_text("%%MatrixMarket\n")
    assert readers.read_matrix_market(spark, str(tmp_path / "empty.mtx")).count() == 0
    (tmp_path / "b.csv").write_text("cell_id,feature,value\nAAAC-1,a,2.5\n")
    assert tuple(readers.read_matrix(spark, str(tmp_path / "b.csv"), "string").first()) == ("AAAC-1", "a", 2.5)
    line = 'chr1\tsrc\tgene\t1\t2\t.\t+\t.\t{}gene_type "protein_coding";\n'
    (tmp_path / "g.gtf").write_text(line.format('gene_name "A"; ') + line.format(""))
    assert [r.gene_name for r in readers.read_gtf(spark, str(tmp_path / "g.gtf"), True).collect()] == ["A"]
    assert readers.read_gtf(spark, str(tmp_path / "g.gtf")).count() == 2


def test_totals_of_overlaps_without_pairs(spark, monkeypatch):
    """As counted from the pairs, for any lengths, ties, repeats, nulls and empty intervals."""
    import random

    from kernloom.plans import registry

    rng = random.Random(11)

    def some(n):
        starts = [rng.choice([rng.randrange(-40, 40), rng.randrange(-(10**6), 10**6)]) for _ in range(n)]
        return [(i % (n - 3), f"chr{i % 2}", s, s + rng.choice([-1, 0, 1, 30, 10**5, 10**8])) for i, s in enumerate(starts)]

    a = [*some(300), (7, None, 1, 4), (None, "chr1", 0, 9), (2**62, "chr0", 0, 5), (2**62, "chr0", 50, 55), (8, "chr1", None, 4)]
    b = [*some(120), (200, None, 1, 4), (201, "chr2", 0, 9), (202, "chr0", 1, None)]
    left = spark.createDataFrame(a, "feature long, chr string, start long, end long")
    right = spark.createDataFrame(b, "g long, chr string, start long, end long").withColumn("gene_name", F.concat(F.lit("g"), "g")).drop("g")
    want = {}
    for f, c, s, e in a:
        for g, d, t, u in b:
            if None not in (c, s, e, d, t, u) and s <= e and t <= u and c == d and s <= u and t <= e:
                n, total = want.get(f"g{g}", (0, 0))
                want[f"g{g}"] = n + 1, total + (f or 0)
    want = {g: v for g, v in want.items() if v[1] < 2**63}
    for stretches in (regions.STRETCHES, 3):
        monkeypatch.setattr(regions, "STRETCHES", stretches)
        some_genes = right.where(F.col("gene_name").isin(list(want)) | F.col("gene_name").isin("g200", "g201", "g202"))
        assert {r[0]: (r[1], r[2]) for r in regions.overlap_totals(left, some_genes, "feature").collect()} == want
    assert regions.overlap_totals(left, right.limit(0), "feature").count() == 0
    # the registered query forms no pairs
    monkeypatch.setattr(regions, "overlap_join", None)
    assert registry.queries()["overlap_mixed_lengths"](spark, "/root/testdata/sf0.001").count() > 0


def test_regions_of_a_large_group_stay_dealt_out(spark):
    anno = spark.range(400).select(F.lit("chr1").alias("chr"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 9).alias("end"), F.lit("+").alias("strand"), F.concat(F.lit("g"), "id").alias("gene_name"))
    sets = anno.select(F.lit("all").alias("group"), F.col("gene_name").alias("gene")).unionByName(spark.createDataFrame([("none", "x"), (None, "x")], "group string, gene string"))
    feats = anno.select(F.concat_ws("-", "chr", "start", "end").alias("feature"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for distinct in (True, False):
            rows = regions.region_groupings(anno, sets, feats, 5, 5, distinct).withColumn("_p", F.spark_partition_id()).persist()
            assert rows.count() == 402 and rows.where("feature IS NULL").count() == 2
            assert rows.where("group = 'all'").groupBy("_p").count().agg(F.max("count")).first()[0] < 200
            rows.unpersist()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
