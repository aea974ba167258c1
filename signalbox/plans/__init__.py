"""Registered queries over the driver tables."""


def load() -> None:
    """Import every module that registers queries."""
    from signalbox.plans import ensembles, evaluation, learned, prompting, scoring, text  # noqa: F401
