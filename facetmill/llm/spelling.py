"""The spelling rules under the name the training-data operators know."""

from facetmill.functions.spelling import plain_spelling  # noqa: F401
