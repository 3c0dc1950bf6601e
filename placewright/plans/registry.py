"""Registered queries and the SQL each one is checked against."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        if name in QUERIES:
            raise ValueError("query registered twice: " + name)
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
