"""Training-data operators: sentences, look-alikes, pieces, markup, languages, scans, token ids, packing, cut texts."""
