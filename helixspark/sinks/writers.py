"""Results as files: JSON, metric tables, FASTA, trees, reports, and merges into a stored catalogue."""

from __future__ import annotations

import html
import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.functions import seq
from helixspark.operators import catalogue

#: Rows that a report for people may hold.
MOST_IN_REPORT = 10_000


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """SNK-10, SNK-12: One JSON object per row, in a folder per value of ``by``."""
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).json(path)


def metrics(df: DataFrame, id_column: str) -> DataFrame:
    """SNK-02: ``(id, Metric, Value)``: one row per column and row, values as text; nulls are ``N/A``."""
    rest = [c for c in df.columns if c != id_column]
    texts = df.select(id_column, *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in rest])
    return texts.unpivot(id_column, rest, "Metric", "Value")


def write_metrics(df: DataFrame, id_column: str, path: str) -> None:
    metrics(df, id_column).write.mode("overwrite").csv(path, header=True)


def fasta_lines(df: DataFrame, name: str = "symbol", sequence: str = "sequence", width: int = 60) -> DataFrame:
    """SNK-06: FASTA records with length, and G + C of bases, in the header and lines of ``width`` letters; rows without letters are left out."""
    body = F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
    s = F.upper(sequence)
    share = F.format_number(100 * seq.gc_fraction(s), 2)
    unit = F.when(s.rlike("^[ACGTUN]+$"), F.concat(F.lit("bp | GC="), share, F.lit("%"))).otherwise("aa")
    line = F.concat(F.lit(">"), F.coalesce(name, F.lit("Sequence")), F.lit(" | length="), F.length(sequence), unit, F.lit("\n"), body)
    return df.where(F.coalesce(F.length(sequence), F.lit(0)) > 0).select(line.alias("value"))


def write_fasta(df: DataFrame, path: str, name: str = "symbol", sequence: str = "sequence", width: int = 60) -> None:
    """SNK-06: ``fasta_lines`` as text files."""
    fasta_lines(df, name, sequence, width).write.mode("overwrite").text(path)


def write_newick(trees: DataFrame, path: str, group: str = "group", tree: str = "upgma") -> None:
    trees.select(F.concat(group, F.lit("\t"), tree).alias("value")).write.mode("overwrite").text(path)


def write_matrix(distances: DataFrame, path: str, row: str, column: str, value: str) -> None:
    """SNK-07: Long distances as a square table; the names become columns, so only small matrices have this form."""
    distances.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row).coalesce(1).write.mode("overwrite").csv(path, header=True)


def html_report(df: DataFrame, title: str, most: int = MOST_IN_REPORT) -> str:
    """SNK-03: A table for people; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in rows)
    return f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"


def write_package(df: DataFrame, folder: str, name: str, id_column: str) -> dict[str, str]:
    """SNK-05: All formats of one result under one name."""
    paths = {kind: os.path.join(folder, f"{name}.{kind}") for kind in ("json", "csv", "parquet")}
    write_json(df, paths["json"])
    write_metrics(df, id_column, paths["csv"])
    df.write.mode("overwrite").parquet(paths["parquet"])
    return paths


def store(df: DataFrame, path: str) -> None:
    """SNK-16: The catalogue's layout: a folder per sequence type, rows of like length together, so that type and length prune the scan.

    Ranges over type and length give every task its share, however few types there are.
    """
    df.repartitionByRange("sequence_type", "length").sortWithinPartitions("sequence_type", "length").write.mode("overwrite").partitionBy("sequence_type").parquet(path)


def store_index(index: DataFrame, path: str, word: str = "kmer", parts: int = 64) -> None:
    """SNK-17: A k-mer index clustered by word."""
    index.repartitionByRange(parts, word).sortWithinPartitions(word).write.mode("overwrite").parquet(path)


def store_trigrams(df: DataFrame, path: str, name: str = "symbol", id_column: str = "id", parts: int = 64) -> None:
    """SNK-16: The trigram index: one row per trigram and record, clustered by trigram."""
    index = df.select(F.col(id_column).alias("id"), F.explode(seq.trigrams(F.col(name))).alias("trigram"))
    store_index(index, path, "trigram", parts)


def write_master(parts: list[DataFrame], path: str, rule: str = "key_or_record") -> DataFrame:
    """SNK-11: The parts, one per species, as one set of records by one of the rules of ``catalogue.deduplicated``, and its totals beside it.

    Records are JSON lines in ``path/genes``; ``path/metadata`` has one line
    with the totals, which are also returned.
    """
    kept = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    kept = catalogue.deduplicated(kept, rule)
    kept.write.mode("overwrite").json(f"{path}/genes")
    totals = catalogue.master_totals(df_or_empty(kept, path))
    totals.write.mode("overwrite").json(f"{path}/metadata")
    return totals


def df_or_empty(kept: DataFrame, path: str) -> DataFrame:
    """The records just written, read under their own schema, so that a file without rows has columns too."""
    return kept.sparkSession.read.schema(kept.schema).json(f"{path}/genes")


def text_report(df: DataFrame) -> DataFrame:
    """SNK-06: ``(id, value)``: the lines of a plain report on each sequence ``(id, s, sequence_type)``: length, and G + C and A + T of bases."""
    s, base = F.col("s"), F.coalesce(F.col("sequence_type") != "protein", F.lit(True))
    share = lambda letters: F.format_number(F.when(F.length(s) > 0, 100 * seq.count_of(s, letters) / F.length(s)).otherwise(0.0), 2)
    lines = F.array(
        F.lit("Analysis Report"), F.lit("=" * 50), F.concat(F.lit("Sequence Length: "), F.length(s), F.when(base, " bp").otherwise(" aa")),
        F.when(base, F.concat(F.lit("GC Content: "), share("GC"), F.lit("%"))), F.when(base, F.concat(F.lit("AT Content: "), share("AT"), F.lit("%"))))
    return df.select("id", F.array_join(F.array_compact(lines), "\n").alias("value"))


def latest_first(df: DataFrame, at: str = "date_added") -> list:
    """The order that puts the latest of repeated keys first: by ``at`` where there is such a column, then by the other plain columns."""
    plain = [c for c, t in df.dtypes if t in ("timestamp", "bigint", "int", "string") and c != at]
    return [*([F.desc_nulls_last(at)] if at in df.columns else []), *[F.desc_nulls_last(c) for c in plain]]


def merge_into(old_path: str, new: DataFrame, key: str, new_path: str) -> None:
    """SNK-08, SNK-09: The stored catalogue with ``new`` merged in, written beside it; of repeated keys in ``new`` the latest row counts."""
    spark = new.sparkSession
    latest = catalogue.first_of(new, [key], latest_first(new))
    catalogue.upsert(spark.read.parquet(old_path).select(*new.columns), latest, key).write.mode("overwrite").parquet(new_path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """SRC-24: ``df`` written once and read back: a cache that outlives the session."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """SNK-04: A workbook as one folder of CSV per sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").csv(os.path.join(folder, name), header=True)


def markdown(df: DataFrame, title: str, most: int = MOST_IN_REPORT) -> str:
    """SNK-13: A table for people in Markdown; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line("-" for _ in df.columns), *map(line, rows)])


def write_sorted(df: DataFrame, path: str, by: str) -> None:
    """SNK-14: CSV in descending order of one column; parts are ranges, so their names are in order."""
    df.orderBy(F.desc_nulls_last(by)).write.mode("overwrite").csv(path, header=True)
