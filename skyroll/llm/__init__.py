"""Training-data operators: packing, licences, chat tools, near and exact
duplicates, toxicity, decontamination, language, binary output, quality."""
