"""Row and sequence operators: splits, segments, packing, chat, masks."""
