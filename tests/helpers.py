"""What several test modules use."""


def rows(df):
    """Rows as a sorted list of tuples, nulls in a place of their own."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
