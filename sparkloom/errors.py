"""What the checks of this package raise before Spark sees a plan."""


class PlanError(ValueError):
    """A query that is well-formed but means nothing useful: repeated output names, ambiguous or missing columns."""
