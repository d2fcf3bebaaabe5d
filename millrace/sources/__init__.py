"""Sources and sinks: JSON lines, repositories, plain texts, token streams and packed arrays."""
