"""All queries of this subpackage by name, and the SQL of those that SQL can express."""

from tideline.llm import ann, bpe, langid, lengths, mixing, neardup, quality, rules, toxicity, urls

MODULES = (ann, mixing, bpe, toxicity, langid, quality, urls, lengths, rules, neardup)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
