"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import compression_quality as _quality
from . import decontamination as _decontamination
from . import licences as _licences
from . import line_spread as _lines
from . import media_archive as _media
from . import mixing as _mixing
from . import ngram_join as _ngrams
from . import repeats as _repeats
from . import secrets as _secrets
from . import token_counts as _token_counts
from .common import read_table, scratch_path

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark, sf_dir):
    mixed = _mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_ngram_join(spark, sf_dir):
    found = _ngrams.similar_components(read_table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_licence_scan(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return _licences.scan(docs, _licences.train(docs)).drop("findings")


def op4_line_dedup(spark, sf_dir):
    return _lines.digest(_lines.cut_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op5_decontamination(spark, sf_dir):
    found = _decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op6_suffix_dedup(spark, sf_dir):
    return _repeats.digest(_repeats.cut_repeats(read_table(spark, sf_dir, "documents")))


def op7_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.train(docs, read_table(spark, sf_dir, "labels")))


def op8_secret_scan(spark, sf_dir):
    return _secrets.digest(_secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op9_token_counts(spark, sf_dir):
    return _token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_media_columns(spark, sf_dir):
    folder = scratch_path(spark, "media")
    _media.write_archives(read_table(spark, sf_dir, "documents"), folder)
    return _media.media_columns(_media.read_archives(spark, folder))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_ngram_join": op2_ngram_join,
    "op3_licence_scan": op3_licence_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_media_columns": op10_media_columns,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": _ngrams.ORACLE_SQL,
    "op4_line_dedup": _lines.ORACLE_SQL,
    "op5_decontamination": _decontamination.ORACLE_SQL,
}
