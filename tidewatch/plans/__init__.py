"""Named queries over the stored tables."""


def load_catalogue():
    """All registered queries by name."""
    from tidewatch.plans import (  # noqa: F401
        check_queries,
        columns_queries,
        data,
        metric_queries,
        model_queries,
        prompt_queries,
        reason_queries,
        reply_queries,
        table_queries,
        text_queries,
    )
    from tidewatch.plans.registry import CATALOGUE

    return CATALOGUE
