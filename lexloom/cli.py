"""Indexing and staleness from the command line: ``python -m lexloom.cli index --repo DIR`` and ``... stale --indices DIR``."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
from collections import defaultdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lexloom.functions import rules as R
from lexloom.functions.scan import self_test
from lexloom.operators import index as I
from lexloom.plans.service import Config
from lexloom.sources import corpus, json_index

KINDS = ("cuarentena", "forzados", "avisos", "duplicados", "metadatos", "truncados")
VERSION = "2.0.0"
_FIELDS = ["id", "ord", *I.SERVED, "_archivo", "_ruta", "_bytes", "_mtime"]


def _schema() -> str:
    kinds = {"ord": "bigint", "_bytes": "bigint", "_mtime": "double"}
    return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in _FIELDS)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Entries, audit rows and meta of the index so far; empty if it is missing or broken."""
    try:
        meta = json.loads(Path(path).read_text("utf-8"))["_meta"]
        meta = meta if isinstance(meta, dict) else {}
        entries, _ = json_index.read_indices(spark, path)
        entries = entries.select(*_FIELDS)
    except (OSError, ValueError, KeyError, TypeError):
        meta, entries = {}, spark.createDataFrame([], _schema())
    seen = meta.get("seguridad") if isinstance(meta.get("seguridad"), dict) else {}
    rows = [(k, f, [str(x) for x in labels]) for k in KINDS for f, labels in (seen.get(k) or {}).items() if isinstance(labels, list)]
    return entries, spark.createDataFrame(rows, "kind string, file string, labels array<string>"), meta


def run_index(spark: SparkSession, args: argparse.Namespace) -> int:
    repo = str(Path(args.repo).resolve())
    path = args.index or os.path.join(Config().indices, f"index_{Path(repo).name}.json")
    country = args.pais or Path(repo).name
    entries, audit, meta = load(spark, path)
    old = (meta.get("seguridad") or {}).get("patrones") if isinstance(meta.get("seguridad"), dict) else None
    force = args.force_all or (bool(meta) and old != R.fingerprint())
    done = I.refresh(corpus.list_files(spark, repo), entries, audit, country, load=lambda df: corpus.load_files(df, repo), force=force, remove_orphans=args.remove_orphans, force_unsafe=args.force_index_unsafe)
    print(f"nuevos {done.new}, modificados {done.modified}, huérfanos {done.orphaned}, leídos {done.read}, errores {done.failed}")
    if not done.changed:
        return 0
    kinds: dict[str, dict[str, list[str]]] = {k: {} for k in KINDS}
    for row in done.audit.orderBy("kind", "file").toLocalIterator():
        kinds[row.kind][row.file] = sorted({*kinds[row.kind].get(row.file, []), *row.labels})
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    meta |= {"generado_en": now, "total_documentos": done.entries.count(), "directorio_base": repo, "pais_predeterminado": country, "version": meta.get("version", VERSION)}
    meta["seguridad"] = {"escaneado_en": now, "patrones": R.fingerprint(), **kinds}
    meta.pop("git_commit", None)
    if commit := corpus.head_commit(repo):
        meta["git_commit"] = commit
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    json_index.export_index(done.entries, meta, path)
    if args.show_warnings:
        for kind in KINDS:
            for file, labels in kinds[kind].items():
                print(f"{kind}: {file}: {', '.join(labels)}")
    print({k: len(v) for k, v in kinds.items()})
    return 3 if args.fail_on_quarantine and kinds["cuarentena"] else 0


def run_stale(spark: SparkSession, folder: str) -> int:
    rows = []
    for path in sorted(Path(folder).glob("index_*.json")):
        try:
            meta = json.loads(path.read_text("utf-8")).get("_meta") or {}
            seen = meta.get("seguridad") or {}
            base = meta.get("directorio_base") or ""
            rows.append((str(meta.get("pais_predeterminado") or path.stem[6:]), base, (Path(base) / ".git").exists() if base else False, meta.get("git_commit"), seen.get("patrones"), corpus.head_commit(base) if base else ""))
        except (OSError, ValueError, AttributeError) as e:
            print(f"{path.name}: {e}", file=sys.stderr)
    df = spark.createDataFrame(rows, "pais_idx string, directorio_base string, is_repo boolean, git_commit string, patrones string, head string")
    found = I.staleness(df, R.fingerprint()).orderBy("pais_idx").collect()
    for r in found:
        print(r.pais_idx, r.rules if r.rules != "OK" else "", r.commit)
    return int(any(r.stale for r in found))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexloom")
    sub = parser.add_subparsers(dest="what", required=True)
    index = sub.add_parser("index", help="build or refresh the index of a corpus")
    index.add_argument("--repo", required=True)
    index.add_argument("--index")
    index.add_argument("--pais")
    for flag in ("force-all", "remove-orphans", "force-index-unsafe", "fail-on-quarantine", "show-warnings"):
        index.add_argument(f"--{flag}", action="store_true")
    stale = sub.add_parser("stale", help="which indices need another run")
    stale.add_argument("--indices", default=Config().indices)
    sub.add_parser("self-test", help="whether every rule finds its own sample")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexloom").getOrCreate()
    if args.what == "index":
        return run_index(spark, args)
    if args.what == "stale":
        return run_stale(spark, args.indices)
    failed: dict[str, list[str]] = defaultdict(list)
    for r in self_test(spark).where("not ok").collect():
        failed[r.label].append(r.surface)
    for problem in [*R.problems(), *(f"{k}: {', '.join(v)}" for k, v in failed.items())]:
        print(problem)
    return int(bool(failed or R.problems()))


if __name__ == "__main__":
    sys.exit(main())
