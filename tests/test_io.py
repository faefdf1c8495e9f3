"""Sources and sinks: malformed CSV rows, round trips."""

import os

from pyspark.sql import types as T

from gapseries.sources import io


def _write(tmp, text):
    p = os.path.join(tmp, "t.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()),
                       T.StructField("c", T.DoubleType())])


def test_malformed_rows_dropped_whatever_columns_are_read(spark, tmpdir_path):
    p = _write(tmpdir_path, "a,b,c\n1,x,1.5\nbad,y,2.5\n3,z,oops\n4,w,4.5\n5,v\n6,u,6.5,extra\n")
    df = io.read_table_csv(spark, p, SCHEMA, land_at=os.path.join(tmpdir_path, "land"))
    # 'bad' and 'oops' do not parse, a field is missing, a field is extra
    assert sorted(df.collect()) == [(1, "x", 1.5), (4, "w", 4.5)]
    assert sorted(r.b for r in df.select("b").collect()) == ["w", "x"] and df.count() == 2


def test_parquet_and_csv_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.5)], SCHEMA)
    io.save_table(df, os.path.join(tmpdir_path, "p"), "parquet")
    assert sorted(spark.read.parquet(os.path.join(tmpdir_path, "p")).collect()) == sorted(df.collect())
    io.save_table(df, os.path.join(tmpdir_path, "c"), "csv")
    back = io.read_table_csv(spark, os.path.join(tmpdir_path, "c"), SCHEMA, materialize=False)
    assert sorted(back.collect(), key=lambda r: r.a) == sorted(df.collect(), key=lambda r: r.a)


def test_series_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, [0.0, 1.0], [2.0, 3.0], "train")],
                               "k int, tw array<double>, v array<double>, split string")
    path = os.path.join(tmpdir_path, "s")
    io.save_series(df, path, partition_by=["split"])
    back = io.load_series(spark, path).select("k", "tw", "v", "split").collect()
    assert back == df.collect()


def test_hyperparams_round_trip(spark, tmpdir_path):
    rows = [(0.05, 3.5, 1.25, -10.0, "1742-6"), (0.2, 1.0, 0.5, -20.0, "1742-6"),
            (0.1, 1.0, 1.0, -5.0, "OTHER")]
    df = spark.createDataFrame(rows, io.HYPERPARAMS_SCHEMA)
    path = os.path.join(tmpdir_path, "hp")
    io.save_hyperparams(df, path)
    r = io.load_hyperparams(spark, path, "1742-6")
    assert (r.sigma2, r.alpha, r.tau, r.log_likelihood) == (0.05, 3.5, 1.25, -10.0)


def test_load_tables_with_declared_schemas(spark, tmpdir_path):
    import gzip

    from gapseries.schemas import D_LABITEMS, DIAGNOSES_ICD
    with gzip.open(os.path.join(tmpdir_path, "D_LABITEMS.csv.gz"), "wt") as f:
        f.write("ROW_ID,ITEMID,LABEL,FLUID,CATEGORY,LOINC_CODE\n1,50912,Creatinine,Blood,Chem,2160-0\n"
                "x,50913,Bad,Blood,Chem,0000-0\n")
    with gzip.open(os.path.join(tmpdir_path, "DIAGNOSES_ICD.csv.gz"), "wt") as f:
        f.write("ROW_ID,SUBJECT_ID,HADM_ID,SEQ_NUM,ICD9_CODE\n1,10,100,1,4280\n2,10,100,2,5715\n")
    t = io.load_tables(spark, tmpdir_path, {"D_LABITEMS": D_LABITEMS, "DIAGNOSES_ICD": DIAGNOSES_ICD})
    assert [r.ITEMID for r in t["D_LABITEMS"].collect()] == [50912]
    assert t["DIAGNOSES_ICD"].count() == 2 and t["DIAGNOSES_ICD"].schema == DIAGNOSES_ICD


def test_load_hyperparams_unknown_item_raises(spark, tmpdir_path):
    import pytest
    df = spark.createDataFrame([(0.05, 3.5, 1.25, -10.0, "A")], io.HYPERPARAMS_SCHEMA)
    path = os.path.join(tmpdir_path, "hp2")
    io.save_hyperparams(df, path)
    with pytest.raises(ValueError):
        io.load_hyperparams(spark, path, "B")
