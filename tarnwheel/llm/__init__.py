"""Operators for text and for records matched by learned or sketched summaries; nothing else imports this."""
