"""Training-data operators. Nothing outside this folder imports it; see :mod:`wobble.llm.queries`."""
