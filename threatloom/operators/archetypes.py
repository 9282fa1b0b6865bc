"""Architecture type of a repository from its files: signals, votes, adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.catalogs import architecture as ar
from threatloom.functions.text import any_of, first_of, lookup, strings

TYPES = list(ar.NAMES)


def _signal(rank: int, test: Column, kind: str, evidence, weight: float, arch: str) -> Column:
    evidence = evidence if isinstance(evidence, Column) else F.lit(evidence)
    return F.when(test, F.struct(
        F.lit(rank).alias("ord"), F.lit(kind).alias("type"), evidence.alias("evidence"), F.lit(weight).alias("weight"),
        F.lit(arch).alias("arch_type")))


def signals(files: DataFrame, repo_languages: DataFrame) -> DataFrame:
    """All signals of each repository.

    Files fold to one row of facts per repository first (flags, counts, and the texts of the few
    manifest files that matter); the signals are then columns over that row.
    """
    path, low = F.col("path"), F.lower("content")
    any_path = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    directory = lambda name: any_path(path.startswith(name + "/"))
    text_of = lambda name: F.max(F.when(path == name, low))
    manifests = sorted({n for names in ar.SIGNAL_MANIFESTS.values() for n in names})
    dirs = ["services", "pkg", "lib", "lambda", "functions", "kubernetes", "k8s", "helm", *ar.FRONTEND_DIRS,
            *ar.DATA_DIRS, *ar.ML_DIRS]
    name = F.element_at(F.split(path, "/"), -1)
    # Distinct directories called cmd: one per prefix, counted before the repository fold.
    cmd = files.where(path.rlike(r"(^|/)cmd/")).select("repo_id", F.explode(F.transform(
        F.filter(F.sequence(F.lit(1), F.size(F.split(path, "/")) - 1),
                 lambda i: F.get(F.split(path, "/"), i - 1) == "cmd"),
        lambda i: F.array_join(F.slice(F.split(path, "/"), 1, i), "/"))).alias("dir")).distinct().groupBy("repo_id").agg(
        F.count("*").alias("n_cmd"))
    workflow = path.startswith(".github/workflows/") & path.rlike(r"\.ya?ml$")
    builds = lambda text: (F.length(text) - F.length(F.replace(text, F.lit("docker build"), F.lit("")))) / len("docker build")
    mains = sorted({n for names in ar.MAIN_FILES.values() for n in names})
    mains = sorted({*mains, *[f"cmd/{n}" for n in mains]})
    facts = files.groupBy("repo_id").agg(
        *[directory(n).alias(f"d_{n}") for n in dirs],
        any_path(path.isin("main.go", "main.py", "index.js", "index.ts")).alias("has_main"),
        F.count_if(name.endswith("Dockerfile")).alias("n_docker"),
        any_path(path.endswith(".ipynb")).alias("notebooks"), any_path(path.endswith(".proto")).alias("protos"),
        *[any_path(path == n).alias(f"f_{n}") for n in ar.SERVERLESS_FILES],
        any_path(path.startswith("terraform/") & path.endswith(".tf") & any_of(low, ar.TERRAFORM_FUNCTIONS)).alias("tf_functions"),
        any_path((path == "Makefile") & any_of(low, ["deploy-lambda", "deploy-function"])).alias("make_functions"),
        any_path(workflow & any_of(low, ["aws-actions/amazon-ecr-login", "docker/build-push-action"])).alias("ci_images"),
        F.coalesce(F.sum(F.when(workflow, builds(F.col("content")))), F.lit(0.0)).alias("ci_builds"),
        any_path(workflow & any_of(low, ["serverless deploy", "sam deploy"])).alias("ci_functions"),
        *[text_of(n).alias(f"t_{n}") for n in manifests],
        *[any_path((path == n) & any_of(low, ar.HTTP_TEXTS)).alias(f"h_{n}") for n in mains],
        *[any_path((path == n) & any_of(low, ar.CLI_TEXTS)).alias(f"c_{n}") for n in mains],
        *[any_path(path == n).alias(f"m_{n}") for n in mains],
    )
    rows = (facts.join(cmd, "repo_id", "left").join(compose_services(files), "repo_id", "left")
            .join(repo_languages, "repo_id", "left").fillna(0, ["n_cmd", "n_services"]).fillna(False, ["has_compose"]))
    c = lambda n: F.col(f"`{n}`")
    out, rank = [], 0

    def add(test, kind, evidence, weight, arch):
        nonlocal rank
        out.append(_signal(rank, test, kind, evidence, weight, arch))
        rank += 1

    structure, dependency, pattern, config = "project-structure", "dependency", "file-pattern", "config"
    add(c("n_cmd") > 1, structure, "multiple cmd directories", 0.8, "microservices")
    add(c("n_cmd") == 1, structure, "single cmd directory", 0.3, "monolith")
    add(c("d_services"), structure, "services/ directory", 0.8, "microservices")
    add((c("d_pkg") | c("d_lib")) & ~c("has_main"), structure, "pkg or lib directory without main", 0.7, "library")
    add(c("d_lambda") | c("d_functions"), structure, "serverless function directories", 0.7, "serverless")
    for group, weight, arch in ((ar.FRONTEND_DIRS, 0.6, "web-app"), (ar.DATA_DIRS, 0.7, "data-pipeline")):
        first = F.coalesce(*[F.when(c(f"d_{n}"), n + "/ directory") for n in group])
        add(first.isNotNull(), structure, first, weight, arch)
    add(sum((c(f"d_{n}").cast("int") for n in ar.ML_DIRS), F.lit(0)) >= 2, structure, "multiple ML directories", 0.6, "ai-ml")

    text = F.lit(None).cast("string")
    for language, names in ar.SIGNAL_MANIFESTS.items():
        text = F.when(c("language") == language, F.coalesce(*[c(f"t_{n}") for n in names])).otherwise(text)
    text = F.coalesce(text, F.lit(""))
    rows = rows.withColumn("manifest", text)
    m = F.col("manifest")
    rpc = any_of(m, ["grpc", "protobuf", "proto"])
    add(rpc, dependency, "gRPC", 0.8, "microservices")
    add(rpc, dependency, "gRPC", 0.7, "api-service")
    for framework, words in ar.WEB_FRAMEWORKS.items():
        add(any_of(m, words), dependency, framework, 0.7, "web-app" if framework in ar.PAGE_FRAMEWORKS else "api-service")
    for words, weight, arch in ((ar.SERVERLESS_DEPS, 0.9, "serverless"), (ar.QUEUE_DEPS, 0.7, "microservices"),
                                (ar.QUEUE_DEPS, 0.6, "data-pipeline"), (ar.ML_DEPS, 0.9, "ai-ml"),
                                (ar.DATA_DEPS, 0.8, "data-pipeline"), (ar.MOBILE_DEPS, 0.7, "mobile-backend")):
        add(any_of(m, words), dependency, first_of(m, words), weight, arch)
    add(any_of(m, ar.CLI_DEPS) & ~any_of(m, ar.CLI_BLOCKERS), dependency, first_of(m, ar.CLI_DEPS), 0.8, "cli")

    add(c("n_docker") > 2, pattern, "multiple Dockerfiles", 0.8, "microservices")
    add(c("n_services") >= 3, pattern, "docker-compose with multiple services", 0.9, "microservices")
    add((c("n_services") < 3) & c("has_compose"), pattern, "docker-compose.yml", 0.4, "monolith")
    add(c("d_kubernetes") | c("d_k8s") | c("d_helm"), pattern, "kubernetes configuration", 0.8, "microservices")
    first = F.coalesce(*[F.when(c(f"f_{n}"), n) for n in ar.SERVERLESS_FILES])
    add(first.isNotNull(), config, first, 0.9, "serverless")
    add(c("tf_functions"), config, "terraform serverless", 0.9, "serverless")
    add(c("notebooks"), pattern, ".ipynb files", 0.6, "ai-ml")
    add(c("protos"), pattern, ".proto files", 0.7, "microservices")

    http, cli = F.lit(False), F.lit(False)
    for language, names in ar.MAIN_FILES.items():
        for n in names:
            # The file itself, else its copy under cmd/.
            seen = lambda flag: F.when(c(f"m_{n}"), c(f"{flag}_{n}")).otherwise(c(f"{flag}_cmd/{n}"))
            here = c("language") == language
            http, cli = http | (here & seen("h")), cli | (here & seen("c"))
    http, cli = F.coalesce(http, F.lit(False)), F.coalesce(cli, F.lit(False))
    add(http & ~cli, "code-pattern", "HTTP server code", 0.6, "api-service")
    add(cli & ~http, "code-pattern", "CLI parser code", 0.7, "cli")
    add(c("make_functions"), config, "serverless Makefile targets", 0.6, "serverless")
    add(c("ci_images") & (c("ci_builds") > 2), config, "CI/CD patterns", 0.5, "microservices")
    add(c("ci_functions"), config, "CI/CD patterns", 0.7, "serverless")
    return rows.select("repo_id", F.explode(F.array_compact(F.array(*out))).alias("s")).select("repo_id", "s.*")


def compose_services(files: DataFrame) -> DataFrame:
    """Lines ending in ":" after the services line of the compose file, as the signal counts them."""
    compose = files.where(F.col("path").isin("docker-compose.yml", "docker-compose.yaml")).groupBy("repo_id").agg(
        F.min_by("content", F.when(F.col("path") == "docker-compose.yml", 0).otherwise(1)).alias("content"))
    lines = compose.select("repo_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    text = F.trim("line")
    opener = text.startswith("services:")
    order = Window.partitionBy("repo_id").orderBy("pos")
    seen = lines.withColumn("open", F.max(opener.cast("int")).over(order))
    return seen.groupBy("repo_id").agg(
        F.count_if((F.col("open") == 1) & ~opener & text.endswith(":")).alias("n_services"),
        F.bool_or(F.col("line").contains("services:")).alias("has_compose"))


def is_model_path(path: Column) -> Column:
    """A file that tells language, dependencies or architecture: markers, manifests, deployment and workflow files."""
    names = {name for table in (ar.LANGUAGE_MARKERS, ar.MANIFESTS, ar.SIGNAL_MANIFESTS) for listed in table.values() for name in listed}
    names |= {*ar.SERVERLESS_FILES, "docker-compose.yml", "docker-compose.yaml", "Makefile"}
    plain = ~path.rlike(r"(^|/)(\.[^/]*|vendor|node_modules)/")
    shaped = path.rlike(r"(^|/)[^/]*Dockerfile$|\.(proto|ipynb)$|^terraform/.*\.tf$|^(kubernetes|k8s|helm)/")
    return path.startswith(".github/workflows/") | (plain & (path.isin(*sorted(names)) | shaped))


def profiles(signal_rows: DataFrame, repositories: DataFrame) -> DataFrame:
    """Primary and secondary type, confidence and description of each repository.

    ``repositories`` (repo_id, language, framework) may hold ones without any signal.  A repository
    has at most as many signals as the catalogue, so its list is small by construction.
    """
    order = lambda column: F.array_position(strings(TYPES), column)
    votes = signal_rows.groupBy("repo_id", "arch_type").agg(F.round(F.sum("weight"), 9).alias("vote"))
    per_repo = votes.groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("vote")).alias("minus"), order(F.col("arch_type")).alias("rank"), "arch_type"))).alias("v"))
    features = signal_rows.where((F.col("type") == "dependency") & (F.col("weight") >= 0.7)).groupBy("repo_id", "evidence").agg(
        F.min("ord").alias("ord")).groupBy("repo_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "evidence"))), lambda f: f["evidence"]).alias("features"))
    rows = repositories.join(per_repo, "repo_id", "left").join(features, "repo_id", "left")
    top = F.try_element_at("v", F.lit(1))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc - x["minus"])
    serves = F.exists("v", lambda x: x["arch_type"] == "api-service")
    primary = F.when(-top["minus"] >= 0.5, top["arch_type"]).when(serves, "monolith").otherwise("unknown")
    rows = rows.withColumn("primary", primary)
    own = F.aggregate(F.filter("v", lambda x: x["arch_type"] == F.col("primary")), F.lit(0.0), lambda acc, x: acc - x["minus"])
    second = F.transform(F.filter("v", lambda x: (x["arch_type"] != F.col("primary")) & (-x["minus"] >= 0.4)), lambda x: x["arch_type"])
    rows = rows.withColumns({
        "secondary": F.coalesce(second, strings([])),
        "confidence": F.least(F.lit(1.0), F.coalesce(own / F.nullif(total, F.lit(0.0)), F.lit(0.0))),
    })
    return rows.withColumn("description", describe()).drop("v", "features")


def describe() -> Column:
    """Language, type, framework and up to three dependency features; three are joined without a
    comma before "and", as the reports have it."""
    known = lambda column, *none: F.coalesce(F.col(column), F.lit("")).isin("", "unknown", *none)
    f, n = F.col("features"), F.coalesce(F.size("features"), F.lit(0))
    g = lambda i: F.get(f, i)
    three = F.concat(g(0), F.lit(", "), g(1), F.lit("and "), g(2))
    joined = (
        F.when(n == 1, g(0)).when(n == 2, F.concat(g(0), F.lit(" and "), g(1)))
        .when(n == 3, three).when(n > 3, F.concat(three, F.lit(" and more")))
    )
    return F.concat(
        F.when(known("language"), "").otherwise(F.concat("language", F.lit(" "))), lookup(ar.NAMES, F.col("primary")),
        F.when(known("framework", "stdlib"), "").otherwise(F.concat(F.lit(" using "), "framework")),
        F.coalesce(F.concat(F.lit(" with "), joined), F.lit("")))


def adjustments(profile_rows: DataFrame) -> DataFrame:
    """Extra threats, risk multipliers, recommendations and controls of each profile's types."""
    pick = lambda i: F.coalesce(lookup({k: strings(v[i]) for k, v in ar.ADJUSTMENTS.items()}, F.col("primary")), strings([]))
    lines = F.array_compact(F.transform("secondary", lambda s: lookup(ar.SECONDARY_THREATS, s)))
    factors = lookup({
        k: F.create_map(*[F.lit(x) for pair in v[1].items() for x in pair]) for k, v in ar.ADJUSTMENTS.items()}, F.col("primary"))
    return profile_rows.withColumns({
        "extra_threats": F.concat(pick(0), lines), "risk_multipliers": factors, "recommendations": pick(2), "controls": pick(3)})
