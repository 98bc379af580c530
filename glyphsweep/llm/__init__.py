"""Operators for preparing language-model training data.

Nothing outside this package imports it. Each module holds one operator with its own
general interface; ``queries`` derives the registered ``opN_*`` queries from them.

Shared conventions: a null text counts as empty; a null key stays null in the result and
never merges rows; columns other than the named key and text are not read, so extra
columns may have any name; an empty table gives an empty result of the same schema.
"""
