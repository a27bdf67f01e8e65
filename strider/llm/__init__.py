"""Training-data operators: language id, chat formatting, near duplicates, mixing, media, HTML, WARC,
substring dedup, URL filters and benchmark decontamination.

Nothing outside this subpackage imports it.
"""
