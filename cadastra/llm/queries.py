"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, licenses, lm, packing, periodic, phrases, pii, quality, secrets, setsketch, simhash, token_counts
from .text import table
from .vocab import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query(quality.ORACLE)
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query()
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm.score(table(spark, sf_dir, "documents"), good, vocabulary("byte_bpe_50k.json"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query()
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


@query(setsketch.ORACLE)
def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_copies(table(spark, sf_dir, "documents"))


@query(phrases.ORACLE)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(table(spark, sf_dir, "documents"), rewrite=periodic.looped))
