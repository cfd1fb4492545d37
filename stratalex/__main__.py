"""Command line: python -m stratalex COMMAND ...; each answers with JSON."""

from __future__ import annotations

import argparse
import json
import sys


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("stratalex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser():
    p = argparse.ArgumentParser(prog="stratalex", description="A Spark-native retrieval engine over versioned snapshots.")
    p.add_argument("--index", required=True, help="folder of the index")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name, *arguments):
        c = commands.add_parser(name)
        for flags, options in arguments:
            c.add_argument(*flags, **options)

    tree = (["--src"], {"required": True, "help": "source tree"})
    add("build", tree, (["--docs"], {"action": "append", "default": []}), (["--policy"], {"default": ""}), (["--flow"], {"default": ""}), (["--prs"], {"default": ""}), (["--commit"], {"default": ""}))
    add("reindex", tree, (["--since"], {"default": ""}), (["--files"], {"nargs": "*", "default": None}), (["--commit"], {"default": ""}))
    add("query", (["intent"], {}), (["-k"], {"type": int, "default": 10}), (["--threshold"], {"type": float, "default": 0.0}), (["--budget"], {"type": int, "default": 0}), (["--language"], {"default": ""}))
    add("keyword", (["query"], {}), (["-k"], {"type": int, "default": 10}))
    add("tool", (["name"], {}), (["--arguments"], {"default": "{}", "help": "a JSON object"}))
    add("promote", (["version"], {}))
    add("freshness", tree)
    add("migrate", (["--dry-run"], {"action": "store_true"}))
    add("glossary", tree, (["--out"], {"required": True}))
    add("model")
    add("eval", (["--fixture"], {"required": True}), (["-k"], {"type": int, "default": 5}))
    return p


def run(arguments, spark):
    from stratalex.operators import store
    from stratalex.plans import engine, service, upkeep
    from stratalex.sources import files, glossary

    a = arguments
    if a.command == "model":  # needs no session
        return {"models": [{"name": "hash", "identity": engine.HASH.identity, "dimension": engine.HASH.dimension}]}
    serve = service.Service(spark, a.index, getattr(a, "src", ""))
    snaps = store.Snapshots(spark, a.index)
    if a.command == "build":
        options = {"docs_roots": a.docs, "policy": glossary.load_policy(a.policy), "commit": a.commit or files.git_head(a.src)}
        if a.flow:
            options["flow_records"] = files.flow_records(spark, a.flow)
        if a.prs:
            options["prs"] = files.pull_requests(spark, a.prs)
        with upkeep.lock(spark, a.index):
            return engine.build(spark, a.src, a.index, **options)
    if a.command == "reindex":
        head = a.commit or files.git_head(a.src)
        since = a.since or (snaps.manifest() or {}).get("indexed_head", "")
        if a.files is not None:  # all are taken as modified
            changes = spark.createDataFrame([("M", f) for f in a.files], "op string, path string")
        else:
            changes = files.git_diff(spark, a.src, since, head)
        with upkeep.lock(spark, a.index):
            return engine.reindex(spark, a.src, a.index, changes, commit=head)
    if a.command == "query":
        return serve.call("context.semantic_search", intent=a.intent, k=a.k, threshold=a.threshold, budget=a.budget, language=a.language)
    if a.command == "keyword":
        return serve.call("context.keyword_search", query=a.query, k=a.k)
    if a.command == "tool":
        return serve.call(a.name, **json.loads(a.arguments))
    if a.command == "promote":
        return snaps.promote(a.version, engine.sound)
    if a.command == "freshness":
        return serve.call("context.get_freshness")
    if a.command == "migrate":
        return {"applied": upkeep.migrate(snaps, dry_run=a.dry_run)}
    if a.command == "glossary":
        tree = files.walk(spark, a.src, languages=["markdown"])
        glossary.write_yaml(glossary.glossary(tree), a.out)
        return {"out": a.out}
    scores, total = service.evaluate(serve, glossary.load_fixture(spark, a.fixture), a.k, threshold=-1)
    return {"queries": service.plain(scores.collect()), "total": service.plain(total.first())}


def main(argv=None):
    arguments = parser().parse_args(argv)
    told = run(arguments, session())
    print(json.dumps(told, ensure_ascii=False, default=str))
    return 1 if isinstance(told, dict) and "error" in told else 0


if __name__ == "__main__":
    sys.exit(main())
