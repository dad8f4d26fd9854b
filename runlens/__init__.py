"""Operations analytics for batch workflows, written as Spark DataFrame plans."""
