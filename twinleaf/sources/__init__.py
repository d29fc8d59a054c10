"""Where fragments come from: trees of source files, their languages and their parts."""
