"""Training-data operators: secrets, dedup, similarity join, packing, mixing and their kin.

Nothing outside this subpackage imports it; ``furrow.llm.queries`` lists its queries.
"""
