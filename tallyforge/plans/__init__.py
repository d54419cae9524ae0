"""Named queries over the tables and the SQL they are compared with.

Each module has a dict QUERIES of (spark, sf_dir) -> DataFrame and a dict ORACLE_SQL of the same names.
"""

from tallyforge.plans import algebra, catalog, layout, readings, sessions, worksheets

MODULES = (worksheets, algebra, readings, sessions, catalog, layout)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
