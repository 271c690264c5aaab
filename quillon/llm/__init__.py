"""Operations that prepare training data: media, search, duplicates, language, tokens, packing, scoring, licences."""
