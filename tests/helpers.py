from pyspark.sql import functions as F

ASSET = ("repo_id string, ord bigint, id string, type string, name string, file string, line bigint, description string, "
         "sensitive boolean, exposed boolean, tags array<string>")
THREAT = ("repo_id string, ord bigint, id string, title string, description string, severity string, stride_primary string, "
          "stride_secondary array<string>, stride_scores map<string,double>, indicators array<struct<type:string,value:string>>, "
          "exploitation_status string, exposure_level string, attack_complexity string, affects_known_assets boolean, "
          "discovered_at string, tags array<string>, source_feeds array<string>, cve_ids array<string>, recommended array<string>, "
          "false_positive boolean, instance_count bigint")
AS_OF = "2024-02-01 00:00:00"


def asset(ord_, type_, file="a.go", line=1, name="n", description="", sensitive=False, exposed=None, repo="r", id_=None):
    return (repo, ord_, id_ or f"{type_}-{ord_}", type_, name, file, line, description, sensitive,
            type_ == "api" if exposed is None else exposed, [type_])


def threat(ord_, title="t", severity="medium", indicators=(), tags=(), feeds=(), cves=(), primary="S", scores=None,
           description="d", exploitation="unknown", exposure="internal", complexity="medium", known=False, at=AS_OF,
           repo="r", count=0, false_positive=False, recommended=()):
    return (repo, ord_, f"th-{ord_}", title, description, severity, primary, [], scores or {primary: 0.9},
            [("ip", v) for v in indicators], exploitation, exposure, complexity, known, at, list(tags), list(feeds), list(cves),
            list(recommended), false_positive, count)


def assets(spark, *rows):
    return spark.createDataFrame(list(rows), ASSET)


def threats(spark, *rows):
    return spark.createDataFrame(list(rows), THREAT).withColumn("discovered_at", F.to_timestamp("discovered_at"))
