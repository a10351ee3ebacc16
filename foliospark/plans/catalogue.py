"""All queries of the core by name, and their SQL."""

from . import assembly, documents, flow_plans, layout, relations, scalars, stream_plans

QUERIES = scalars.QUERIES | relations.QUERIES | documents.QUERIES | layout.QUERIES | flow_plans.QUERIES | assembly.QUERIES | stream_plans.QUERIES
SQL = scalars.SQL | relations.SQL | documents.SQL | layout.SQL | flow_plans.SQL | assembly.SQL | stream_plans.SQL
