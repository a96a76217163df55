"""Queries over the given tables, one module per family of operators."""


def load() -> None:
    """Import every module that registers queries."""
    from pagelake.plans import crawl, ledger, pages, payloads, relations, urls  # noqa: F401
