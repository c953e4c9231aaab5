"""python -m threadloom.cli COMMAND ...: queries, SQL, the graph and its index over a folder of tables.

stats NAME [--limit N] [--json]; NAME is one of the canned queries. sql 'SELECT ...' [--json] runs one statement and shows
all its rows (or --limit of them), sql without one reads statements, with .tables, .schema and .quit. query indexes
(--index, with --clear, --limit and --enrich-only) or finds the context of a question (--mode, or --local). visualize (viz)
writes the graph for an explorer. discover-types counts the labels of a sample of topics. An unknown command exits with 2,
a failing statement with 1.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException

from . import config
from .functions.register import register
from .operators import graph as G
from .operators import kg as K
from .operators import panels, pipeline
from .operators import reports as R
from .operators.views import Corpus
from .session import session, ship
from .sources import guide
from .sources.sinks import graph_payload, json_rows, text_table, write_if_changed

#: Labels that discover-types counts, and words by which a title shows them.
LABELS = {"fault": ("crash", "stall", "freez", "stops", "fail", "error"), "wish": ("idea", "wish", "please"), "question": ("how", "why", "?"), "place": ("station", "yard", "line", "near")}

STATS = {
    "tags": R.tags_distribution, "users": R.users_top, "categories": R.categories_breakdown, "activity": R.activity_monthly, "unanswered": R.unanswered,
    "velocity": R.topic_velocity, "responses": R.response_time_by_category, "themes": R.theme_frequency, "profile": R.structure_profile,
}


def _repl(spark, corpus: Corpus, names: list[str], show) -> None:
    for line in sys.stdin:
        line = line.strip().rstrip(";")
        if line in (".quit", ".exit"):
            return
        if line == ".tables":
            print("\n".join(names))
        elif line.startswith(".schema"):
            for n in line.split()[1:] or names:
                print(n, spark.table(n).schema.simpleString() if n in names else "unknown")
        elif line:
            try:
                print(show(spark.sql(line)))
            except PySparkException as e:
                print(f"error: {e}", file=sys.stderr)


def _query(a: argparse.Namespace, corpus: Corpus, show) -> int:
    state = a.state or f"{corpus.sf_dir}/.state"
    if a.index or a.enrich_only:
        print(text_table(pipeline.index(corpus, state, a.clear, a.limit, a.enrich_only, lambda x: print(x, file=sys.stderr))))
        return 0
    if not a.question:
        print("a question, or --index", file=sys.stderr)
        return 2
    relations = K.relations(corpus)
    print(show(pipeline.context(corpus, K.merged_nodes(K.entities(corpus)), K.merged_edges(relations), relations, a.question, a.mode).orderBy("score", "kind", "item", ascending=[False, True, True])))
    return 0


def _visualize(a: argparse.Namespace, corpus: Corpus) -> int:
    nodes, edges = K.merged_nodes(K.entities(corpus)), K.merged_edges(K.relations(corpus))
    shown = G.degrees(nodes, edges).where(f"degree >= {a.min_degree}").select("name")
    kept = edges.join(shown.toDF("a"), "a", "left_semi").join(shown.toDF("b"), "b", "left_semi")
    bucketed = G.classified_edges(kept, G.token_buckets(G.keyword_counts(kept), a.buckets))
    signature = G.signature(nodes, edges).first().signature
    payload = graph_payload(nodes.join(shown, "name", "left_semi").select("name", "entity_type"), bucketed)
    wrote = write_if_changed(a.out, payload)
    print(f"{'wrote' if wrote else 'unchanged'} {a.out} {signature}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="threadloom")
    parser.add_argument("--data", default=".")
    parser.add_argument("--master", default=None)
    commands = parser.add_subparsers(dest="command", required=True)
    stats = commands.add_parser("stats")
    stats.add_argument("name", choices=[*STATS, "search"])
    stats.add_argument("term", nargs="?", default="")
    sql = commands.add_parser("sql")
    sql.add_argument("statement", nargs="?")
    query = commands.add_parser("query")
    query.add_argument("question", nargs="?")
    query.add_argument("--mode", choices=pipeline.MODES, default="mix")
    query.add_argument("--local", dest="mode", action="store_const", const="local")
    for flag in ("--index", "--clear", "--enrich-only"):
        query.add_argument(flag, action="store_true")
    query.add_argument("--state", default=None)
    viz = commands.add_parser("visualize", aliases=["viz"])
    viz.add_argument("--out", default="graph.json")
    viz.add_argument("--min-degree", type=int, default=0)
    viz.add_argument("--buckets", type=int, default=12)
    types = commands.add_parser("discover-types")
    types.add_argument("--sample-size", type=int, default=30)
    types.add_argument("--out", default=None)
    for p in (stats, sql, query, types):
        p.add_argument("--limit", type=int, default=R.LIMIT if p is stats else None)
        p.add_argument("--json", action="store_true")
    a = parser.parse_args(argv)
    set_ = config.layered(os.getcwd(), a.data, {"MASTER": a.master})
    spark = ship(session(set_["MASTER"] or None))
    corpus = Corpus(spark, set_["DATA_DIR"])
    show = lambda df: (json_rows if a.json else text_table)(df, a.limit)
    if a.command == "stats":
        print(show(R.search(corpus, a.term) if a.name == "search" else STATS[a.name](corpus)))
        return 0
    if a.command == "query":
        return _query(a, corpus, show)
    if a.command in ("visualize", "viz"):
        return _visualize(a, corpus)
    if a.command == "discover-types":
        sample = panels.sampled(corpus.topics.where("title IS NOT NULL").select("id", "title"), "id", a.sample_size)
        found = panels.label_frequency(sample, "title", LABELS).orderBy("n", "label", ascending=[False, True])
        print(show(found))
        if a.out:
            guide.write_vocabulary(a.out, [r.label.capitalize() for r in found.collect()], guide.load_vocabulary(a.out) if os.path.exists(a.out) else None)
        return 0
    names = corpus.register()
    register(spark)
    if a.statement is None:
        _repl(spark, corpus, names, show)
        return 0
    try:
        print(show(spark.sql(a.statement)))
    except PySparkException as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
