"""Training-data operators: chat formatting, quality rules, secret scans, WARC, HTML extraction,
near-duplicates, byte-level BPE, language-model scoring, URL filters and benchmark decontamination."""
