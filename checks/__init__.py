"""Queries over the test tables, each with the SQL another engine must agree with."""


def load_all() -> None:
    from checks import compare_checks, derive_checks, evaluate_checks, model_checks  # noqa: F401
