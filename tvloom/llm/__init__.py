"""Training-data operators: tokenisation, deduplication, decontamination, language, privacy, HTML, WARC, sharding."""
