"""Every operator as a named query over the given tables, with SQL that checks it."""

from mlscout.catalog import cleaning, evaluation, learning, profiling, recipes, reporting

MODULES = [profiling, cleaning, recipes, evaluation, reporting, learning]


def all_queries():
    found = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def all_oracles():
    found = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
