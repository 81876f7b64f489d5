"""Training-data operators: packing, mixing, nearest neighbours, language, substrings, pages,
quality, chat, shards and near-duplicates. ``queries`` registers one ``opN_`` query for each."""
