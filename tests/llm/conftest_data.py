DATA = "/root/testdata/sf0.01"
