"""Provider resource types and the asset types they become. Types that are not listed give a warning and no node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Resource types of Terraform, CloudFormation and Pulumi, and the asset type of each.
TERRAFORM = {
    "aws_api_gateway_rest_api": "api_gateway",
    "aws_apigatewayv2_api": "api_gateway",
    "azurerm_api_management": "api_gateway",
    "google_compute_backend_service": "backend_service",
    "google_compute_region_backend_service": "backend_service",
    "google_storage_bucket": "bucket",
    "aws_s3_bucket": "bucket",
    "azurerm_storage_account": "bucket",
    "aws_s3_bucket_cors_configuration": "bucket",
    "aws_s3_bucket_lifecycle_configuration": "bucket",
    "aws_s3_bucket_logging": "bucket",
    "aws_s3_bucket_versioning": "bucket",
    "aws_s3_bucket_ownership_controls": "bucket",
    "aws_s3_bucket_replication_configuration": "bucket",
    "aws_cloudfront_distribution": "cdn",
    "google_compute_backend_bucket": "cdn",
    "tls_cert_request": "certificate",
    "tls_self_signed_cert": "certificate",
    "tls_locally_signed_cert": "certificate",
    "acme_certificate": "certificate",
    "aws_ecs_task_definition": "container",
    "google_sql_database_instance": "database",
    "google_redis_instance": "database",
    "aws_db_instance": "database",
    "aws_rds_instance": "database",
    "aws_rds_cluster": "database",
    "aws_elasticache_cluster": "database",
    "azurerm_sql_server": "database",
    "azurerm_postgresql_server": "database",
    "google_bigquery_dataset": "database",
    "google_bigquery_table": "database",
    "google_compute_disk": "disk",
    "aws_ebs_volume": "disk",
    "azurerm_managed_disk": "disk",
    "google_dns_record_set": "dns_record",
    "aws_route53_record": "dns_record",
    "azurerm_dns_a_record": "dns_record",
    "cloudflare_record": "dns_record",
    "google_compute_firewall": "firewall_rule",
    "aws_security_group": "firewall_rule",
    "azurerm_network_security_group": "firewall_rule",
    "aws_lambda_function": "function",
    "google_cloudfunctions_function": "function",
    "google_cloudfunctions2_function": "function",
    "azurerm_function_app": "function",
    "azurerm_linux_function_app": "function",
    "azurerm_windows_function_app": "function",
    "google_compute_health_check": "health_check",
    "google_storage_bucket_iam_binding": "iam_binding",
    "google_storage_bucket_iam_member": "iam_binding",
    "google_project_iam_binding": "iam_binding",
    "google_project_iam_member": "iam_binding",
    "google_service_account_iam_binding": "iam_binding",
    "google_kms_crypto_key_iam_binding": "iam_binding",
    "google_kms_key_ring_iam_binding": "iam_binding",
    "google_kms_key_ring_iam_member": "iam_binding",
    "aws_iam_role_policy_attachment": "iam_binding",
    "aws_iam_policy_attachment": "iam_binding",
    "aws_iam_user_policy_attachment": "iam_binding",
    "aws_iam_user_group_membership": "iam_binding",
    "aws_iam_group_membership": "iam_binding",
    "aws_iam_group_policy_attachment": "iam_binding",
    "azurerm_role_assignment": "iam_binding",
    "aws_iam_group": "iam_group",
    "google_storage_bucket_iam_policy": "iam_policy",
    "google_project_iam_policy": "iam_policy",
    "google_service_account_iam_policy": "iam_policy",
    "google_kms_crypto_key_iam_policy": "iam_policy",
    "aws_iam_policy": "iam_policy",
    "aws_s3_bucket_acl": "iam_policy",
    "aws_s3_bucket_policy": "iam_policy",
    "kubernetes_ingress": "ingress",
    "google_compute_instance_group": "instance_group",
    "google_compute_instance_group_manager": "instance_group",
    "aws_autoscaling_group": "instance_group",
    "google_compute_address": "ip_address",
    "google_compute_global_address": "ip_address",
    "aws_eip": "ip_address",
    "azurerm_public_ip": "ip_address",
    "google_kms_key_ring": "kms_key",
    "google_kms_crypto_key": "kms_key",
    "aws_kms_key": "kms_key",
    "azurerm_key_vault_key": "kms_key",
    "google_compute_forwarding_rule": "load_balancer",
    "google_compute_target_pool": "load_balancer",
    "aws_lb": "load_balancer",
    "aws_alb": "load_balancer",
    "aws_elb": "load_balancer",
    "azurerm_lb": "load_balancer",
    "pingdom_check": "monitor",
    "kubernetes_namespace": "namespace",
    "google_compute_network": "network",
    "aws_vpc": "network",
    "azurerm_virtual_network": "network",
    "google_container_cluster": "node",
    "google_container_node_pool": "node",
    "aws_eks_cluster": "node",
    "azurerm_kubernetes_cluster": "node",
    "aws_dynamodb_table": "nosql_database",
    "azurerm_cosmosdb_account": "nosql_database",
    "kubernetes_deployment": "pod",
    "google_pubsub_topic": "pubsub",
    "aws_sns_topic": "pubsub",
    "google_pubsub_subscription": "queue",
    "aws_sqs_queue": "queue",
    "kubernetes_secret": "secret",
    "aws_secretsmanager_secret": "secret",
    "aws_ecs_service": "service",
    "kubernetes_service": "service",
    "google_cloud_run_service": "service",
    "google_cloud_run_v2_service": "service",
    "aws_iam_role": "service_account",
    "aws_iam_user": "service_account",
    "google_service_account": "service_account",
    "aws_cloudfront_origin_access_identity": "service_account",
    "google_compute_subnetwork": "subnet",
    "aws_subnet": "subnet",
    "azurerm_subnet": "subnet",
    "google_compute_instance": "vm",
    "aws_instance": "vm",
    "azurerm_virtual_machine": "vm",
    "azurerm_linux_virtual_machine": "vm",
    "azurerm_windows_virtual_machine": "vm",
}
CLOUDFORMATION = {
    "AWS::ApiGateway::RestApi": "api_gateway",
    "AWS::ApiGatewayV2::Api": "api_gateway",
    "AWS::S3::Bucket": "bucket",
    "AWS::CloudFront::Distribution": "cdn",
    "AWS::CertificateManager::Certificate": "certificate",
    "AWS::ECS::TaskDefinition": "container",
    "AWS::RDS::DBInstance": "database",
    "AWS::RDS::DBCluster": "database",
    "AWS::ElastiCache::CacheCluster": "database",
    "AWS::ElastiCache::ReplicationGroup": "database",
    "AWS::EBS::Volume": "disk",
    "AWS::EFS::FileSystem": "disk",
    "AWS::Route53::RecordSet": "dns_record",
    "AWS::Route53::HostedZone": "dns_record",
    "AWS::EC2::SecurityGroup": "firewall_rule",
    "AWS::Lambda::Function": "function",
    "AWS::IAM::Group": "iam_group",
    "AWS::IAM::Policy": "iam_policy",
    "AWS::AutoScaling::AutoScalingGroup": "instance_group",
    "AWS::EC2::EIP": "ip_address",
    "AWS::KMS::Key": "kms_key",
    "AWS::ElasticLoadBalancingV2::LoadBalancer": "load_balancer",
    "AWS::ElasticLoadBalancingV2::TargetGroup": "load_balancer",
    "AWS::ElasticLoadBalancingV2::Listener": "load_balancer",
    "AWS::EC2::VPC": "network",
    "AWS::EC2::InternetGateway": "network",
    "AWS::EC2::NatGateway": "network",
    "AWS::EC2::RouteTable": "network",
    "AWS::EC2::SubnetRouteTableAssociation": "network",
    "AWS::EC2::VPCGatewayAttachment": "network",
    "AWS::EKS::Cluster": "node",
    "AWS::DynamoDB::Table": "nosql_database",
    "AWS::SNS::Topic": "pubsub",
    "AWS::SQS::Queue": "queue",
    "AWS::SecretsManager::Secret": "secret",
    "AWS::ECS::Service": "service",
    "AWS::IAM::Role": "service_account",
    "AWS::IAM::InstanceProfile": "service_account",
    "AWS::IAM::User": "service_account",
    "AWS::EC2::Subnet": "subnet",
    "AWS::EC2::Instance": "vm",
    "AWS::AutoScaling::LaunchConfiguration": "vm",
}
PULUMI = {
    "aws:apigateway/restApi:RestApi": "api_gateway",
    "aws:apigatewayv2/api:Api": "api_gateway",
    "gcp:compute/backendService:BackendService": "backend_service",
    "gcp:compute/regionBackendService:RegionBackendService": "backend_service",
    "aws:s3/bucket:Bucket": "bucket",
    "aws:s3/bucketV2:BucketV2": "bucket",
    "gcp:storage/bucket:Bucket": "bucket",
    "azure-native:storage:StorageAccount": "bucket",
    "azure:storage/account:Account": "bucket",
    "aws:cloudfront/distribution:Distribution": "cdn",
    "gcp:compute/backendBucket:BackendBucket": "cdn",
    "azure-native:cdn:Endpoint": "cdn",
    "aws:acm/certificate:Certificate": "certificate",
    "tls:index/selfSignedCert:SelfSignedCert": "certificate",
    "tls:index/locallySignedCert:LocallySignedCert": "certificate",
    "aws:ecs/taskDefinition:TaskDefinition": "container",
    "aws:rds/instance:Instance": "database",
    "aws:rds/cluster:Cluster": "database",
    "aws:elasticache/cluster:Cluster": "database",
    "aws:elasticache/replicationGroup:ReplicationGroup": "database",
    "gcp:sql/databaseInstance:DatabaseInstance": "database",
    "gcp:redis/instance:Instance": "database",
    "gcp:bigquery/dataset:Dataset": "database",
    "gcp:bigquery/table:Table": "database",
    "azure-native:sql:Server": "database",
    "azure-native:dbforpostgresql:Server": "database",
    "azure-native:dbformysql:Server": "database",
    "azure:sql/server:Server": "database",
    "azure:postgresql/server:Server": "database",
    "aws:ec2/volume:Volume": "disk",
    "gcp:compute/disk:Disk": "disk",
    "aws:route53/record:Record": "dns_record",
    "aws:route53/zone:Zone": "dns_record",
    "gcp:dns/recordSet:RecordSet": "dns_record",
    "aws:ec2/securityGroup:SecurityGroup": "firewall_rule",
    "gcp:compute/firewall:Firewall": "firewall_rule",
    "azure-native:network:NetworkSecurityGroup": "firewall_rule",
    "azure:network/networkSecurityGroup:NetworkSecurityGroup": "firewall_rule",
    "aws:lambda/function:Function": "function",
    "gcp:cloudfunctions/function:Function": "function",
    "gcp:cloudfunctionsv2/function:Function": "function",
    "gcp:compute/healthCheck:HealthCheck": "health_check",
    "aws:iam/rolePolicyAttachment:RolePolicyAttachment": "iam_binding",
    "aws:iam/userPolicyAttachment:UserPolicyAttachment": "iam_binding",
    "aws:iam/groupPolicyAttachment:GroupPolicyAttachment": "iam_binding",
    "gcp:projects/iAMBinding:IAMBinding": "iam_binding",
    "gcp:projects/iAMMember:IAMMember": "iam_binding",
    "azure-native:authorization:RoleAssignment": "iam_binding",
    "aws:iam/group:Group": "iam_group",
    "aws:s3/bucketPolicy:BucketPolicy": "iam_policy",
    "aws:iam/policy:Policy": "iam_policy",
    "gcp:projects/iAMPolicy:IAMPolicy": "iam_policy",
    "kubernetes:networking.k8s.io/v1:Ingress": "ingress",
    "aws:autoscaling/group:Group": "instance_group",
    "gcp:compute/instanceGroup:InstanceGroup": "instance_group",
    "gcp:compute/instanceGroupManager:InstanceGroupManager": "instance_group",
    "aws:ec2/eip:Eip": "ip_address",
    "gcp:compute/address:Address": "ip_address",
    "gcp:compute/globalAddress:GlobalAddress": "ip_address",
    "azure-native:network:PublicIPAddress": "ip_address",
    "azure:network/publicIp:PublicIp": "ip_address",
    "aws:kms/key:Key": "kms_key",
    "gcp:kms/keyRing:KeyRing": "kms_key",
    "gcp:kms/cryptoKey:CryptoKey": "kms_key",
    "azure-native:keyvault:Vault": "kms_key",
    "azure:keyvault/keyVault:KeyVault": "kms_key",
    "aws:lb/loadBalancer:LoadBalancer": "load_balancer",
    "aws:alb/loadBalancer:LoadBalancer": "load_balancer",
    "aws:lb/targetGroup:TargetGroup": "load_balancer",
    "aws:lb/listener:Listener": "load_balancer",
    "gcp:compute/forwardingRule:ForwardingRule": "load_balancer",
    "gcp:compute/targetPool:TargetPool": "load_balancer",
    "azure-native:network:LoadBalancer": "load_balancer",
    "azure:lb/loadBalancer:LoadBalancer": "load_balancer",
    "kubernetes:core/v1:Namespace": "namespace",
    "aws:ec2/vpc:Vpc": "network",
    "aws:ec2/internetGateway:InternetGateway": "network",
    "aws:ec2/natGateway:NatGateway": "network",
    "aws:ec2/routeTable:RouteTable": "network",
    "aws:ec2/routeTableAssociation:RouteTableAssociation": "network",
    "gcp:compute/network:Network": "network",
    "azure-native:network:VirtualNetwork": "network",
    "azure:network/virtualNetwork:VirtualNetwork": "network",
    "aws:ecs/cluster:Cluster": "node",
    "aws:eks/cluster:Cluster": "node",
    "gcp:container/cluster:Cluster": "node",
    "gcp:container/nodePool:NodePool": "node",
    "azure-native:containerservice:ManagedCluster": "node",
    "azure:containerservice/kubernetesCluster:KubernetesCluster": "node",
    "aws:dynamodb/table:Table": "nosql_database",
    "kubernetes:apps/v1:Deployment": "pod",
    "aws:sns/topic:Topic": "pubsub",
    "gcp:pubsub/topic:Topic": "pubsub",
    "aws:sqs/queue:Queue": "queue",
    "gcp:pubsub/subscription:Subscription": "queue",
    "aws:secretsmanager/secret:Secret": "secret",
    "gcp:secretmanager/secret:Secret": "secret",
    "kubernetes:core/v1:Secret": "secret",
    "aws:ecs/service:Service": "service",
    "gcp:cloudrun/service:Service": "service",
    "gcp:cloudrunv2/service:Service": "service",
    "kubernetes:core/v1:Service": "service",
    "aws:iam/role:Role": "service_account",
    "aws:iam/user:User": "service_account",
    "aws:iam/instanceProfile:InstanceProfile": "service_account",
    "gcp:serviceAccount/account:Account": "service_account",
    "aws:ec2/subnet:Subnet": "subnet",
    "gcp:compute/subnetwork:Subnetwork": "subnet",
    "azure-native:network:Subnet": "subnet",
    "azure:network/subnet:Subnet": "subnet",
    "aws:ec2/instance:Instance": "vm",
    "gcp:compute/instance:Instance": "vm",
    "azure-native:compute:VirtualMachine": "vm",
    "azure:compute/virtualMachine:VirtualMachine": "vm",
}
TABLES = {"terraform": TERRAFORM, "cloudformation": CLOUDFORMATION, "pulumi": PULUMI}


def resource_types(source: str) -> dict[str, str]:
    """Resource type -> asset type."""
    return TABLES[source]


def resource_type_lookup(spark: SparkSession, source: str) -> DataFrame:
    """(resource_type, asset): a constant table of at most 123 rows, small enough to broadcast."""
    return spark.createDataFrame(sorted(resource_types(source).items()), "resource_type string, asset string")
