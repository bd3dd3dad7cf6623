"""Index build: Markdown rows to every index table (the whole of sections SRC, PRJ, CHK, LEX1, GRF1, AGG)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.joins import materialise
from marginalia.operators import governance, lexical, links, notes as N, pruning, registry, vectors
from marginalia.operators.corpus import build_corpus
from marginalia.sources import files


@dataclass
class Index:
    notes: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    rejected: DataFrame

    def corpus(self) -> DataFrame:
        return build_corpus(self.chunks, self.notes)

    def tables(self, as_of: str | None = None) -> dict[str, DataFrame]:
        """All tables of a written index (SRC5); the cleanup report needs the day it speaks of."""
        corpus = materialise(self.corpus())
        report = {} if as_of is None else {"cleanup_report": governance.cleanup_report(self.notes, self.chunks, as_of)}
        rows, totals = materialise(lexical.postings(corpus)), materialise(lexical.field_stats(corpus))
        term_df = rows.groupBy("term").agg(F.count("*").alias("df"))
        return report | {
            "corpus": corpus,
            "notes": self.notes.drop("body"),
            "chunks": self.chunks,
            "nodes": self.nodes,
            "edges": self.edges,
            "lexical_postings": rows,
            "lexical_blocks": pruning.posting_blocks(lexical.index_from_tables(rows, term_df, totals), corpus),
            "lexical_stats": totals,
            "term_df": term_df,
            "vectors": vectors.embed_chunks(corpus).select("chunk_id", "note_id", "values"),
            "diagnostics": registry.diagnostics(self.notes, self.unresolved),
            "manifest": files.index_manifest(self.notes.select("id", "path", "repo_slug", "content_hash"), self.chunks, self.edges),
        }


def build_index(raw: DataFrame, *, owners: list[str] | None = None, strict: bool = False) -> Index:
    """Raw ``path, content, mtime_ms`` rows to an index.

    Unreadable YAML and invalid strict notes go to ``rejected``; with
    ``strict`` they, repeated ids and unresolved links raise when read.
    """
    # Every table below reads the parsed notes: they are written once.
    parsed = materialise(N.parse_frontmatter(N.split_frontmatter(raw)))
    bad_yaml = parsed.filter("parse_error = 'frontmatter.invalid_yaml'").select(
        "path", F.col("parse_error").alias("code"), F.col("parse_message").alias("message"))
    good = parsed.filter("parse_error IS NULL OR parse_error = 'frontmatter.missing_block'")
    checked = N.validate_frontmatter(N.strict_candidates(good), **({"owners": owners} if owners else {}))
    broken = checked.filter(~F.col("ok")).select("path", F.col("errors")[0]["code"].alias("code"), F.col("errors")[0]["message"].alias("message"))
    rejected = bad_yaml.unionByName(broken)
    notes = materialise(N.index_notes(good.join(broken.select("path"), "path", "left_anti")))
    chunks = N.build_chunks(notes)
    typed = links.explode_links(notes)
    nodes, edges, unresolved = links.build_graph(notes, typed, links.extract_links(notes))
    reg = registry.build_registry(notes, chunks, typed, unresolved, strict=strict)
    if strict:
        def stop(df: DataFrame, text) -> DataFrame:
            return df.select(F.raise_error(text).cast("string").alias("id"))

        # Guards ride along as rows that raise when they exist.
        guard = stop(rejected, F.concat_ws(": ", "code", "message")).unionByName(
            stop(unresolved, F.concat(F.lit("links.target_missing: "), "from_id", F.lit(" references missing note ids "), "target")))
        reg = reg.join(guard.distinct(), "id", "left_anti")
    return Index(reg, chunks, nodes, edges, unresolved, rejected)


def incremental(previous: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR4: ``(changed raw rows, state of every path)`` against the last manifest."""
    diff = registry.diff_manifest(previous, raw.select("path", "mtime_ms"))
    changed = raw.join(diff.filter("state = 'updated'").select("path"), "path", "left_semi")
    return changed, diff
