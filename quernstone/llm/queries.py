"""The registered queries of this subpackage, and their SQL."""

from . import ann, bpe, chat, exact_dedup, language_id, licences, merkle, mixing, negatives, ngram_join, packing, quality, sharding

MODULES = [exact_dedup, licences, bpe, quality, ngram_join, chat, packing, ann, language_id, sharding, mixing, merkle, negatives]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in getattr(m, "SQL", {}).items()}
