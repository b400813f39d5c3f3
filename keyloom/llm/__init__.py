"""Training-data operators: quality, licences, language, duplicates, URLs, benchmarks, chat, tokens, privacy.

Nothing outside this folder imports it. ``queries`` and ``oracles`` hold the
registered queries; every other module holds one operator.
"""
