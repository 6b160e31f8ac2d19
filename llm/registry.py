"""The queries of this package, and SQL where SQL can express them."""

from llm import bpe, codes, fingerprints, html_text, line_dedup, mixing, neighbours, packing, quality, sharding, simhash, toxicity, whitening

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mixing,
        quality.op2_quality,
        sharding.op3_sharding,
        neighbours.op4_neighbours,
        fingerprints.op5_fingerprints,
        line_dedup.op6_line_dedup,
        simhash.op7_simhash,
        bpe.op8_bpe,
        toxicity.op9_toxicity,
        html_text.op10_html,
        codes.op11_codes,
        whitening.op12_whitening,
        packing.op13_packing,
    )
}
ORACLES = {"op1_mixing": mixing.OP1_SQL, "op6_line_dedup": line_dedup.OP6_SQL, "op11_codes": codes.OP11_SQL}
