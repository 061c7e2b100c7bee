"""Command line: build an index, search it softly, or show exact hits.

    python -m lexiquarry.cli index --index DIR --vectors PARQUET FILE
    python -m lexiquarry.cli search --index DIR "phrase"
    python -m lexiquarry.cli exact --index DIR "phrase"

FILE may be - for standard input. --config_path names a JSON or YAML file of defaults for the options.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.soft import reached_threshold
from .operators.tokenizers import TOKENIZERS, WORDS, Tokenizer
from .plans.index import Index, PhraseTooLong, UnknownWord
from .sources.text import json_lines, standard_input, text_files
from .sources.vectors import EMBEDDINGS

RED, BLUE, OFF = "\x1b[31m", "\x1b[34m", "\x1b[0m"


def parser(defaults: dict | None = None) -> argparse.ArgumentParser:
    every: set[str] = set()
    out = argparse.ArgumentParser(prog="lexiquarry")
    sub = out.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("input")
    index.add_argument("--vectors", required=True)
    index.add_argument("--backend", default="plain")
    index.add_argument("--tokenizer", default="words")
    index.add_argument("--model", default=None, help="file or name of the tokenizer's model")
    index.add_argument("--max_vocab", type=int, default=2**19)
    index.add_argument("--jsonl_key", default=None, help="each line is a JSON object with its text under this key")
    search = sub.add_parser("search")
    search.add_argument("pattern")
    search.add_argument("--num_candidates", type=int, default=20)
    search.add_argument("--min_similarity", type=float, default=0.45)
    search.add_argument("--max_runtime", type=float, default=None)
    exact = sub.add_parser("exact")
    exact.add_argument("pattern")
    exact.add_argument("--display", type=int, default=10)
    exact.add_argument("--padding", type=int, default=100)
    for p in (index, search, exact):
        p.add_argument("--index", required=True)
        p.add_argument("--config_path", default=None)
        known = {a.dest for a in p._actions}
        p.set_defaults(**{k: v for k, v in (defaults or {}).items() if k in known})
        for a in p._actions:
            a.required = a.required and a.dest not in (defaults or {})
        every |= known
    if unknown := set(defaults or {}) - every:
        out.error(f"no such options: {', '.join(sorted(unknown))}")
    return out


def defaults_of(path: str) -> dict:
    """Options by name, of a JSON file, or of a YAML file where that library is there."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def options(argv: list[str] | None = None) -> argparse.Namespace:
    """Options as given, else as the file of --config_path has them, else the engine's own."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config_path", default=None)
    path = first.parse_known_args(argv)[0].config_path
    return parser(defaults_of(path) if path else None).parse_args(argv)


def result_table(rows: list) -> list[str]:
    """Lines of (rank, score, match_count, phrase): score as per cent with one decimal."""
    width = max(6, *(len(f"{r.match_count:,}") for r in rows)) if rows else 6
    lines = [f"| Rank | Score | {'#Match'.rjust(width)} | String", "-" * (20 + width + max([6, *(len(r.phrase) for r in rows)]))]
    return lines + [f"| {r.rank:>4} | {round(r.score * 100, 1):>5} | {r.match_count:>{width},} | {r.phrase}" for r in rows]


def corpus_of(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A text file, or standard input: each line is a document of its own, numbered in order."""
    lines = text_files(spark, standard_input(spark) if path == "-" else path)
    return (json_lines(lines, "text", key) if key else lines).select(F.col("line_id").alias("doc_id"), "text")


def tokenizer_named(name: str, model: str | None = None) -> Tokenizer:
    """A plug-in by name; those that are made from a model are given it."""
    found = TOKENIZERS[name] if name else WORDS
    if not callable(found):
        return found
    return found(model=model) if model else found()


def main(argv: list[str] | None = None) -> int:
    args = options(argv)
    spark = SparkSession.builder.getOrCreate()
    began = time.perf_counter()
    if args.command == "index":
        tokenizer = tokenizer_named(args.tokenizer, args.model)
        built = Index.build(spark, corpus_of(spark, args.input, args.jsonl_key), EMBEDDINGS[args.backend](spark, args.vectors), args.index, tokenizer, args.max_vocab)
        print({k: round(v, 2) for k, v in built.timers.report().items()})
        meta = built.report()
        print(f"#Lines     : {meta['documents']:,}\n#Tokens    : {meta['tokens']:,}\n#Vocabulary: {meta['words']:,} (ids for {meta['cap']:,})")
        return 0
    index = Index.load(spark, args.index)
    try:
        if args.command == "search":
            rows = index.search(args.pattern, args.num_candidates, args.min_similarity, args.max_runtime).collect()
            print("\n".join(result_table(rows)))
            tail = "" if len(rows) >= args.num_candidates else f" with similarity >={int(100 * reached_threshold([r.score for r in rows], args.num_candidates, args.min_similarity) + 0.5)}%"
            print(f"{BLUE}[Output {len(rows)} hits{tail}]{OFF}")
        else:
            hits = index.count(args.pattern).first().match_count
            for r in index.contexts(args.pattern, args.display, args.padding).collect():
                print(f"[{r.n}] {r.left}{RED}{r.match}{OFF}{r.right}\n")
            print(f"#Hits: {hits:,}" + (f" (only {args.display} are displayed)" if hits > args.display else ""))
    except (PhraseTooLong, UnknownWord) as e:
        print(f"{RED}{e}{OFF}")
        return 1
    print(f"{BLUE}[Search time: {time.perf_counter() - began:.3f} sec]{OFF}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
