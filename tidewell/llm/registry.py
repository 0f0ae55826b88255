"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from tidewell.llm import decontam, embeddings, language_model, lines, pieces, preferences, quality, secrets, simhash, token_counts
from tidewell.llm.common import table


def op1_spherical_caps(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_line_templates(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


def op3_gated_model(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_length_histogram(spark, sf_dir):
    return token_counts.report(table(spark, sf_dir, "documents"))


def op5_preference_pairs(spark, sf_dir):
    return preferences.report(table(spark, sf_dir, "conversations"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark, sf_dir):
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op9_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontam.NEAR)


def op10_piece_codec(spark, sf_dir):
    return pieces.digest_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_spherical_caps": op1_spherical_caps,
    "op2_line_templates": op2_line_templates,
    "op3_gated_model": op3_gated_model,
    "op4_length_histogram": op4_length_histogram,
    "op5_preference_pairs": op5_preference_pairs,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_piece_codec": op10_piece_codec,
}

ORACLE_SQL = {
    "op2_line_templates": lines.ORACLE,
    "op5_preference_pairs": preferences.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op9_decontamination": decontam.ORACLE,
}
