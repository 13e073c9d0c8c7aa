"""Writers: record lines, splits with a report, judge packets, blind pairs with a separate key, ledgers."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, Observation, functions as F

from talkmill.functions.banks import JUDGE_CRITERIA


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """One JSON object per line; null fields are left out. Returns the number of lines, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", True).json(path)
    return seen.get["n"]


def write_prepared(cleaned: DataFrame, folder: str) -> DataFrame:
    """all, train and val parts of a cleaned corpus (columns reason, part); returns the counts per reason."""
    kept = cleaned.where("reason is null")
    write_jsonl(kept.drop("reason", "part"), f"{folder}/all")
    for part in ("train", "val"):
        write_jsonl(kept.where(F.col("part") == part).drop("reason", "part"), f"{folder}/{part}")
    report = cleaned.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).count().orderBy(F.desc("count"), "reason")
    write_jsonl(report, f"{folder}/report")
    return report


def write_pairwise(pairs: DataFrame, folder: str) -> None:
    """Blind items, and the key that tells the sides apart in a file of its own."""
    ident = F.sha2(F.concat_ws("|", "id", "n"), 256)
    write_jsonl(pairs.select(ident.alias("item"), "a", "b"), f"{folder}/items")
    write_jsonl(pairs.select(ident.alias("item"), "swapped"), f"{folder}/key")


def append_ledger(rows: DataFrame, path: str) -> None:
    write_jsonl(rows, path, mode="append")


def write_judge_file(requests: DataFrame, path: str, criteria: tuple[str, ...] = JUDGE_CRITERIA) -> int:
    """Judge packets (id, model, scenario_id, category, transcript) with the criteria to score."""
    return write_jsonl(requests.withColumn("criteria", F.array(*[F.lit(c) for c in criteria])), path)


def write_selected(winners: DataFrame, path: str) -> int:
    """Winning candidates as training talks: (id, source, messages) with the winner (text) as the last turn."""
    last = F.array(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    head = F.expr("if(element_at(messages, -1).role = 'assistant', slice(messages, 1, size(messages) - 1), messages)")
    return write_jsonl(winners.select("id", "source", F.concat(head, last).alias("messages")), path)


def write_evaluation(summary: DataFrame, transcripts: DataFrame, per_scenario: DataFrame, folder: str) -> None:
    """A summary row, the transcripts and the facts per scenario."""
    for name, df in (("summary", summary), ("transcripts", transcripts), ("per_scenario", per_scenario)):
        write_jsonl(df, f"{folder}/{name}")


def checksum(rows: DataFrame, *columns: str) -> str:
    """Sixteen hex digits that stand for the set of rows, whatever their order: a hash of counts and sums of row hashes."""
    each = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns]), 256)
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    r = rows.select(each.alias("h")).agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(13).alias("b"), part(25).alias("c")).head()
    return hashlib.sha256(f"{r.n}|{r.a}|{r.b}|{r.c}".encode()).hexdigest()[:16]


def freeze(rows: DataFrame, category: str, columns: tuple[str, ...], path: str) -> dict:
    """Write the manifest of a benchmark: its size, checksum and rows per category (few)."""
    counts = {r[0]: r[1] for r in rows.groupBy(category).count().collect()}  # categories of a benchmark
    info = {"n": sum(counts.values()), "checksum": checksum(rows, *columns), "categories": dict(sorted(counts.items(), key=str)), "columns": list(columns)}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(info, f, indent=2)
    return info


def verify_frozen(rows: DataFrame, path: str) -> None:
    """Refuse to go on with a benchmark that is not the frozen one."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"benchmark not frozen: {path}")
    with open(path, encoding="utf-8") as f:
        info = json.load(f)
    now = checksum(rows, *info["columns"])
    if now != info["checksum"]:
        raise RuntimeError(f"benchmark changed: frozen {info['checksum']}, now {now}")


def scaling_report(summaries: DataFrame, size: str, metrics: tuple[str, ...], path: str, most: int = 1_000) -> str:
    """A Markdown table of runs by size with a bar per metric; a report has at most ``most`` runs."""
    rows = summaries.select("model", size, *metrics).orderBy(size, "model").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report takes at most {most} runs")
    text = ["| model | " + " | ".join((size, *metrics)) + " |", "|" + "---|" * (len(metrics) + 2)]
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else f"{v:,}"
    text += ["| " + " | ".join([str(r["model"]), show(r[size]), *(show(r[m]) for m in metrics)]) + " |" for r in rows]
    for m in metrics:
        known = [r[m] for r in rows if r[m] is not None]
        top = max(known, default=0) or 1
        text += ["", f"### {m} by {size}", "```", *[f"{show(r[size]):>14} {'#' * round(40 * (r[m] or 0) / top)} {show(r[m])}" for r in rows], "```"]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(text) + "\n")
    return "\n".join(text)
