"""The registered corpus queries: columns of the contract, SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from boutique.llm.queries import ORACLE, QUERIES
from tools.check_oracle import RAW, digest

COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"], "op2": ["query_id", "rank", "vec_id", "score"],
    "op3": ["doc_id", "held_out", "score", "predicted"], "op4": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5": ["doc_id", "class_id"], "op6": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op8": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op11": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12": ["vec_id", "n_links", "component_id", "kept"],
    "op13": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op9": ["doc_id", "held_out", "lang_pred", "score"], "op10": ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_quality", "op9_language"}))
def test_query(spark, sf_small, name):
    got = entry_mod.queries()[name](spark, sf_small).toPandas()
    assert list(got.columns)[:len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]] and len(got)
    if name in ORACLE:
        con = duckdb.connect()
        for t in RAW:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
        assert digest(got) == digest(con.execute(ORACLE[name]).df())
    elif name.startswith("op"):
        assert len(got) == spark.read.parquet(f"{sf_small}/documents.parquet").count()


def test_held_out_labels(spark, sf_small):
    """Held-out documents are scored better than by their most frequent label or language."""
    labels = spark.read.parquet(f"{sf_small}/labels.parquet").toPandas().set_index("doc_id")
    scored = entry_mod.queries()["op1_quality"](spark, sf_small).toPandas()
    assert list(scored.columns) == COLUMNS["op1"] and scored.score.between(0, 1).all()
    quality = scored.set_index("doc_id").join(labels, how="inner")
    held = quality[quality.held_out]
    assert (held.predicted == held.quality).mean() >= 0.9
    lang = spark.read.parquet(f"{sf_small}/documents.parquet").toPandas().set_index("doc_id").lang
    predicted = entry_mod.queries()["op9_language"](spark, sf_small).toPandas()
    assert list(predicted.columns) == COLUMNS["op9"] and len(predicted) == len(lang)
    found = predicted.set_index("doc_id").join(lang)
    found = found[found.held_out & (found.lang_pred != "und")]
    assert (found.lang == found.lang_pred).mean() >= 0.97
