"""Registered queries; `all_queries` loads every module that registers some."""


def all_queries():
    from corpusmill.plans import flows, modelled, records, registry, text, theta  # noqa: F401

    return registry
