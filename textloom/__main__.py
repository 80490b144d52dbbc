"""Demonstrations on the command line: python -m textloom taxonomy [FOLDER] and python -m textloom cluster."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from textloom.operators import cluster as C
from textloom.operators import taxonomy
from textloom.providers import HashingEmbedding
from textloom.sources import io

RECIPES = [
    ("bread.txt", "Rye bread needs a sour starter.\nA sour starter rises overnight in a warm bowl.\nRye bread keeps for a week."),
    ("rolls.txt", "Soft rolls need wheat flour and warm milk.\nWheat flour makes a soft dough.\nA soft dough rises in an hour."),
    ("soup.txt", "Pea soup needs a bay leaf.\nPea soup thickens overnight.\nServe it with rye bread."),
]
STATEMENTS = ["how many guests came", "guests came how many", "sales of the summer", "summer sales", "stock of the north store", "north store stock", "returned parcels"]


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="textloom")
    parser.add_argument("what", choices=["taxonomy", "cluster"])
    parser.add_argument("folder", nargs="?", help="text files; without one, a demonstration's own texts")
    parser.add_argument("--pattern", default="*.txt")
    parser.add_argument("--threshold", type=float, default=0.6)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if given.what == "taxonomy":
        texts = io.read_text_files(spark, given.folder, given.pattern) if given.folder else io.from_texts(spark, RECIPES)
        made = taxonomy.build(io.corpus_units(texts), HashingEmbedding(), config=taxonomy.TaxonomyConfig(similarity_threshold=given.threshold, min_confidence=0.3), strict=True)
        out = io.format_taxonomy(made.topics)
    else:
        texts = io.read_text_files(spark, given.folder, given.pattern).collect() if given.folder else [(f"s{i}", t) for i, t in enumerate(STATEMENTS)]
        docs = io.documents_from_dicts(spark, [{"id": a, "text": b} for a, b in texts])
        labelled = C.cluster(docs, HashingEmbedding(), config=C.ClusterConfig(similarity_threshold=given.threshold, min_confidence=0.3, sanity_mode="warn"))
        out = "\n".join(f"{r.cluster_id} ({r.size}): " + "; ".join(m.text for m in r.members) for r in io.clusters_for_display(labelled).collect())
    print(out)
    return out


if __name__ == "__main__":
    main()
