"""Operations for preparing language-model training text, each a DataFrame -> DataFrame job."""
