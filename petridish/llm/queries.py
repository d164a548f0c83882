"""Registered queries of the pipeline operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from petridish.llm import (
    alignment,
    automata,
    fingerprints,
    kneser,
    language,
    licences,
    negatives,
    packing,
    pieces,
    quality,
    quantised,
    simhash,
    suffixes,
)

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_language": language.op2_language,
    "op3_licences": licences.op3_licences,
    "op4_pieces": pieces.op4_pieces,
    "op5_packing": packing.op5_packing,
    "op6_quality": quality.op6_quality,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_quantised": quantised.op8_quantised,
    "op9_automata": automata.op9_automata,
    "op10_simhash": simhash.op10_simhash,
    "op11_kneser": kneser.op11_kneser,
    "op12_alignment": alignment.op12_alignment,
    "op13_negatives": negatives.op13_negatives,
}

ORACLES: dict[str, str] = {
    "op1_fingerprints": fingerprints.SQL,
    "op8_quantised": quantised.SQL,
    "op9_automata": automata.SQL,
    "op13_negatives": negatives.SQL,
}
