"""Census-format readers on small hand-made files in the published layouts."""

import os

from pyspark.sql import functions as F

from blockflow.plans import stages
from blockflow.sources import census


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_census_readers_and_build(spark, tmp_path):
    d = str(tmp_path)
    hdr10 = "GISJOIN,STATEA," + ",".join(f"H7X00{k}" for k in range(1, 9))
    _write(f"{d}/b10.csv", hdr10 + "\n"
           "G01000100201001000,1,10,4,3,1,1,0,1,0\n"
           "G01000100201001001,1,5,5,0,0,0,0,0,0\n")
    hdr20 = "GISJOIN,GEOCODE,STATEA,COUNTY,U7B001," + ",".join(f"U7B00{k}" for k in range(3, 10))
    _write(f"{d}/b20.csv", hdr20 + "\n"
           "G0100010020100,10010201001000,1,Doña Ana County,12,6,3,1,1,0,1,0\n"
           "G0100010020101,10010201001001,1,Doña Ana County,2,2,0,0,0,0,0,0\n", encoding="latin-1")
    rel_hdr = "﻿STATE_2010|COUNTY_2010|TRACT_2010|BLK_2010|BLKSF_2010|STATE_2020|COUNTY_2020|TRACT_2020|BLK_2020|EXTRA"
    _write(f"{d}/rel/tab_st01.csv", rel_hdr + "\n"
           "1|1|20100|1000|A|1|1|20100|1000|x\n"
           "1|1|20100|1001|A|1|1|20100|1000|x\n"
           "1|1|20100|1001|A|1|1|20100|1001|x\n")
    b10 = census.read_block2010(spark, f"{d}/b10.csv")
    b20 = census.read_block2020(spark, f"{d}/b20.csv")
    cw = census.read_relationship(spark, f"{d}/rel/*.csv")
    assert sorted(r.ID10 for r in b10.collect()) == [10010201001000, 10010201001001]
    assert b20.where(F.col("COUNTY") == "Doña Ana County").count() == 2        # Latin-1 text intact
    assert sorted((r.ID10, r.ID20) for r in cw.collect()) == [
        (10010201001000, 10010201001000), (10010201001001, 10010201001000), (10010201001001, 10010201001001)]
    # the whole preparation on these inputs: 2010 block 1001 (5 people) is split over two 2020 blocks
    tri = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]
    polys = spark.createDataFrame([(10010201001000, tri), (10010201001001, tri)],
                                  "GEOID20 long, geometry array<array<struct<x:double,y:double>>>")
    dim = spark.createDataFrame([(1, "Doa Ana County")], "id long, name string")
    paths = stages.build_datasets(b10, b20, cw, polys, dim, f"{d}/out")
    mig = {r.ID20: (r.eq_P10, r.block_diff) for r in spark.read.parquet(paths["total_attr"]).collect()}
    # eq_P10: 10 + 2.5 = 12.5 -> diff 12 - 12.5 = -0.5 -> 0 (half even); 2.5 -> diff -0.5 -> 0
    assert mig == {10010201001000: (12, 0), 10010201001001: (2, 0)}
    tp = spark.read.parquet(paths["total_population"])
    assert tp.count() == 14 and tp.where("county = 1").count() == 14
