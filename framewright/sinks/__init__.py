"""Where results go: files by chapter, caption files, stage marks."""
