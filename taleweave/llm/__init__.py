"""Training-data operators: ten DataFrame-in, DataFrame-out jobs over documents, pages and chats."""
