"""All queries of the scene-graph engine with their oracles."""

from chronoscene.plans import dataset_queries, frame_queries, graph_queries, spec_queries, stsl_queries, text_queries

MODULES = (stsl_queries, spec_queries, graph_queries, text_queries, frame_queries, dataset_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
