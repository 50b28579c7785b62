"""Pages and processed files as markdown on disk: scanned, parsed and written by Spark."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # frontmatter is then read line by line
    yaml = None

#: Pages that only lead to others.
NAVIGATION = ("index.md", "log.md", "Home.md")
_PAIR = re.compile(r"^([A-Za-z_][\w-]*):(?:\s+(.*))?$")


def _quoted(block: str) -> str:
    """Values with a bare ``: `` in them get quotes, which is what keeps most broken blocks from parsing."""
    out = []
    for line in block.splitlines():
        m = _PAIR.match(line)
        value = (m.group(2) or "").strip() if m else ""
        out.append(f"{m.group(1)}: {json.dumps(value, ensure_ascii=False)}" if ": " in value and value[:1] not in "\"'[{|>&*" else line)
    return "\n".join(out)


def _plain(block: str) -> dict:
    pairs = (_PAIR.match(line) for line in block.splitlines())
    return {m.group(1): (m.group(2) or "").strip().strip("\"'") or None for m in pairs if m}


def parse_block(block: str) -> dict:
    """The fields of a frontmatter block; {} if it isn't a mapping even after a repair."""
    if yaml is None:
        return _plain(block)
    for text in (block, _quoted(block)):
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError:
            continue
        return found if isinstance(found, dict) else {}
    return {}


def split_page(text: str) -> tuple[dict, str]:
    """Frontmatter and body. A block without fences above the first heading counts too, and wins."""
    fields: dict = {}
    lines = text.lstrip("\n").splitlines()
    if lines and lines[0].strip() == "---":
        end = next((i for i, ln in enumerate(lines[1:], 1) if ln.strip() == "---"), None)
        if end is not None:
            fields, lines = parse_block("\n".join(lines[1:end])), lines[end + 1 :]
    body = "\n".join(lines).strip("\n")
    head, mark, rest = body.partition("\n# ")
    loose = [ln for ln in head.splitlines() if ln.strip() and ln.strip() != "---"]
    if mark and loose and all(_PAIR.match(ln) or re.match(r"^\s*-\s", ln) for ln in loose):
        fields, body = {**fields, **parse_block("\n".join(loose))}, "# " + rest
    return fields, body


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, folder, slug, fields (JSON), body of the markdown files under ``folder``, without navigation pages.

    Files whose name begins with an underscore are left to Spark's rule and not read.
    """
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    root = str(PurePosixPath(folder))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                rel = path.split(root, 1)[-1].lstrip("/")
                name = rel.rsplit("/", 1)[-1]
                if name in NAVIGATION:
                    continue
                fields, body = split_page(bytes(content).decode("utf-8", "replace"))
                rows.append((rel, rel.split("/")[0] if "/" in rel else "", name[:-3], json.dumps(fields, default=str, ensure_ascii=False), body))
            yield pd.DataFrame(rows, columns=["rel_path", "folder", "slug", "fields", "body"])

    return texts.select("path", "content").mapInPandas(run, "rel_path string, folder string, slug string, fields string, body string")


def render_page(fields: dict, body: str) -> str:
    """A page as a file; values are JSON, which is YAML too."""
    head = "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False, default=str)}" for k, v in fields.items())
    return f"---\n{head}\n---\n\n{(body or '').strip()}\n"


def rendered(pages: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """page_id, content: pages as files, with the given columns as frontmatter; nulls aren't written."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["content"] = [render_page({c: v for c, v in json.loads(f).items()}, body) for f, body in zip(b["fields"], b["body"])]
            yield b[["page_id", "content"]]

    fields = F.to_json(F.struct(*[F.col(c) for c in columns]))
    return pages.select("page_id", fields.alias("fields"), "body").mapInPandas(run, "page_id long, content string")


def parsed(files: DataFrame) -> DataFrame:
    """page_id, fields (JSON), body of rendered pages."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [split_page(c) for c in b["content"]]
            yield pd.DataFrame({"page_id": b["page_id"], "fields": [json.dumps(f, default=str, ensure_ascii=False) for f, _ in both], "body": [t for _, t in both]})

    return files.mapInPandas(run, "page_id long, fields string, body string")
