"""Entity salience analytics as DataFrame operators.

Every operator takes and returns DataFrames keyed by ``doc_id`` and
``entity_id`` and works on the whole collection in one job.
"""
