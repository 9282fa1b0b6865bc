"""Manifests on one line against the same manifests over lines."""

import json

from threatloom.operators import manifests as mf

PACKAGE = {"name": "web", "scripts": {"start": "node a: b"}, "dependencies": {"express": "^4.1.0", "@scope/x": "~2.0"}, "devDependencies": {"jest": "29"}}
POM = ["<project>", "<version>1</version>", "<dependencies>", "<dependency>", "<groupId>g</groupId>", "<artifactId>spring-core</artifactId>",
       "<version>6.1</version>", "</dependency>", "<dependency>", "<artifactId>kafka-clients</artifactId>", "</dependency>", "</dependencies>", "</project>"]


def found(spark, path, language, content):
    files = spark.createDataFrame([("r", path, content)], "repo_id string, path string, content string")
    languages = spark.createDataFrame([("r", language)], "repo_id string, language string")
    return [(r.name, r.version) for r in mf.dependencies(files, languages).orderBy("pos").collect()]


def test_one_line_and_many_lines_give_equal_dependencies(spark):
    want = [("express", "4.1.0"), ("@scope/x", "2.0"), ("jest", "29")]
    tail = {"dependencies": PACKAGE["dependencies"], "devDependencies": PACKAGE["devDependencies"]}
    for text in (json.dumps(PACKAGE), json.dumps(PACKAGE, separators=(",", ":")) + "\n", json.dumps(tail, indent=2)):
        assert found(spark, "package.json", "javascript", text) == want
    for text in ("".join(POM), " ".join(POM), "\n".join(POM)):
        assert found(spark, "pom.xml", "java", text) == [("spring-core", "6.1"), ("kafka-clients", "")]


def test_broken_and_empty_manifests(spark):
    broken = '{"dependencies": {"a": "1"'
    for text in (broken, "", "{}", "null", '{"dependencies": null}', '{"dependencies": "x"}', None):
        assert found(spark, "package.json", "javascript", text) == []
    # Over lines, a file that is cut off still tells its first entries.
    assert found(spark, "package.json", "javascript", '{\n"dependencies": {\n"a": "1"') == [("a", "1")]
    assert found(spark, "pom.xml", "java", "<project/>") == []
