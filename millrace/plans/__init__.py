"""Queries over the project's tables, each with the SQL that checks it."""


def modules():
    from millrace.plans import diffs, duplicates, evaluation, metrics, quality, records, selection

    return [quality, metrics, duplicates, evaluation, selection, records, diffs]
